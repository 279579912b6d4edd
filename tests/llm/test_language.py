import zlib
from collections import defaultdict
from math import log2

import numpy as np

from lexmill.llm import ppm


def plain_tree(train):
    count = defaultdict(lambda: defaultdict(int))
    for t in train:
        raw = b"\0\0\0" + t
        for i in range(3, len(raw)):
            for order in range(4):
                count[raw[i - order : i]][raw[i]] += 1
    return {context: (seen, sum(seen.values())) for context, seen in count.items()}


def plain_bits(tree, text):
    """PPM with method-C escapes, byte by byte from dictionaries."""
    bits, raw = 0.0, b"\0\0\0" + text
    for i in range(3, len(raw)):
        for order in (3, 2, 1, 0):
            seen, n = tree.get(raw[i - order : i], ({}, 0))
            if not seen:
                continue
            if raw[i] in seen:
                bits -= log2(seen[raw[i]] / (n + len(seen)))
                break
            bits -= log2(len(seen) / (n + len(seen)))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    train = [b"the cat sat on the mat", b"a cat, a hat", b""]
    other = ["der Hund saß im Haus".encode()]
    grams = {}
    for lang, texts in (("en", train), ("de", other)):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        keys, n = np.unique(ppm.four_grams(raw, np.cumsum([0, *map(len, texts)])), return_counts=True)
        grams[lang] = keys, n.astype(float)
    model = ppm.freeze(grams)
    tests = [b"the hat", b"der Hut", b"", b"z", "ßßß".encode(), b"a cat sat, the", b"", b"the cat" * 300_000]
    got = model.bits(np.frombuffer(b"".join(tests), np.uint8), np.cumsum([0, *map(len, tests)]))
    trees = plain_tree(other), plain_tree(train)
    for i, t in enumerate(tests[:-1]):
        assert np.allclose(got[i], [plain_bits(tree, t) for tree in trees], rtol=1e-5), t
    # a text longer than a step: the first copy, and each further one after "cat"
    one, two = ([plain_bits(tree, b"the cat" * n) for tree in trees] for n in (1, 2))
    assert np.allclose(got[-1], np.array(one) + 299_999 * (np.array(two) - one), rtol=1e-5)


def test_whole_table_against_brute_force(docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    langs = sorted({r.lang for r in rows if r.lang is not None})
    trees = [plain_tree([r.text.encode() for r in rows if r.lang == lang and not held(r)]) for lang in langs]
    got = {r.doc_id: r for r in ppm.identify(docs).collect()}
    assert len(got) == len(rows)
    right = []
    for r in rows:
        raw = r.text.encode()
        rate = [plain_bits(tree, raw) / len(raw) for tree in trees]
        mine = got[r.doc_id]
        assert mine.held_out == held(r) and mine.lang_pred == langs[int(np.argmin(rate))]
        assert abs(mine.bits_per_byte - min(rate)) < 1e-4 and abs(mine.score - 2 ** -min(rate) / sum(2**-x for x in rate)) < 1e-4
        right += [mine.lang_pred == r.lang] if held(r) else []
    assert sum(right) >= 0.97 * len(right)
    assert len({round(x.score, 3) for x in got.values()}) > 20


def test_bounded_sample(docs):
    """A bound that binds leaves whole texts of every language and still tells them apart."""
    some = ppm.training_rows(docs, 20_000).collect()
    size = defaultdict(int)
    for r in some:
        size[r.lang] += len(r.text.encode())
    assert set(size) == {r.lang for r in docs.select("lang").distinct().collect()} and max(size.values()) < 60_000
    whole = {(r.lang, r.text) for r in docs.collect()}
    assert all((r.lang, r.text) in whole for r in some)
    got = ppm.identify(docs, ppm.train(docs, 20_000)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_odd_rows(spark, docs, odd, none):
    got = {r.doc_id: r for r in ppm.identify(odd).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[4].score == 0
    assert got[5].lang_pred in ("en", "de") and got[None].held_out
    assert ppm.identify(none).count() == 0 and ppm.keep_identified(none).count() == 0
    model = ppm.train(docs)
    mixed = odd.withColumn("letters", odd.size).unionByName(spark.createDataFrame([(20, "Der Hund schläft nicht. " * 5, None), (21, "A" + "".join(chr(0x3400 + i) for i in range(900)), "en")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    kept = ppm.keep_identified(mixed, model)
    assert kept.columns == mixed.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert {1, None, 5, 6, 8, 20} <= set(rows) and not {2, 3, 4, 21} & set(rows)
    assert rows[20].lang == "de" and rows[5].lang == "en" and rows[5].letters == "clash"
