import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm import bpe, ppm
from lexmill.llm.substrings import LENGTH
from tests.llm.test_decontaminate import brute, brute_longest, low
from tests.llm.test_language import plain_bits, plain_tree
from tests.llm.test_neardup import direct, weights


def identified(rows):
    held = lambda r: r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    langs = sorted({r["lang"] for r in rows if r["lang"] is not None and r["text"] and not held(r)})
    trees = [plain_tree([r["text"].encode() for r in rows if r["lang"] == lang and r["text"] is not None and not held(r)]) for lang in langs]
    out = []
    for r in rows:
        raw = (r["text"] or "").encode()
        if not any(c.isalpha() for c in r["text"] or "") or not trees:
            continue
        rate = [plain_bits(tree, raw) / len(raw) for tree in trees]
        if min(rate) < ppm.RANDOM:
            out.append(r | {"lang": langs[int(np.argmin(rate))] if r["lang"] is None else r["lang"]})
    return out


def firsts(rows):
    texts = sorted({r["text"] for r in rows if r["text"] is not None})
    ws, label = [weights(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if set(ws[i]) & set(ws[j]) and direct(ws[i], ws[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    of = dict(zip(texts, label, strict=True))
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256(r["text"].encode()).digest()[:16])
    least = {}
    for r in sorted((r for r in rows if r["text"] is not None), key=order):
        least.setdefault(of[r["text"]], r)
    return [r for r in rows if r["text"] is None] + list(least.values())


def without_repeats(rows):
    """Earlier windows remove later ones; a character with a byte removed goes whole."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        raw = (r["text"] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - LENGTH + 1):
            w = raw[k : k + LENGTH]
            if w in seen:
                gone[k : k + LENGTH] = True
            seen.add(w)
        if not gone.any():
            out.append(r)
            continue
        at, kept = 0, []
        for c in r["text"]:
            n = len(c.encode())
            if not gone[at : at + n].any():
                kept.append(c)
            at += n
        if kept:
            out.append(r | {"text": "".join(kept)})
    return out


def clean(rows, items):
    def affected(text):
        if brute(text, items)[2] >= 2:
            return True
        n, _ = brute_longest(text or "", [x for x in items if len(low(x[1])) >= 8])
        return n >= 13 or any(f" {' '.join(low(t))} " in f" {' '.join(low(text))} " for _, t in items if 8 <= len(low(t)) < 13)

    return [r for r in rows if not affected(r["text"])]


def encoded(rows):
    t = Tokenizer.from_file(bpe.tokenizer_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        out.append((str(r["doc_id"]), len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def as_rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def check(spark, folder):
    """Each stage on all that its predecessor kept, then run(), against the plain statements of the rules."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r.asDict() for r in docs.collect()]
    sizes = [len(rows)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (identified, firsts, without_repeats, lambda x: clean(x, items), encoded), strict=True):
        docs, rows = stage(spark, docs, folder), plain(rows)
        if plain is encoded:
            break
        for r in rows:  # the cut text has another length
            if "n_chars" in r and r["text"] is not None and name == "repeated_passages":
                r["n_chars"] = len(r["text"])
        assert as_rows(docs) == sorted(str(sorted(r.items())) for r in rows), name
        sizes.append(len(rows))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(rows)
    return sizes


def test_stages_and_run_against_brute_force(spark, sf):
    sizes = check(spark, sf)
    assert sizes[1] > sizes[2] and sizes[3] > sizes[4], "the table has near copies and contaminated documents"


def test_odd_rows_end_to_end(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    extra = spark.createDataFrame([(30, "Der Hund und die Katze sind im Garten. " * 3, None), (31, "The dog sleeps in the garden all day long and does not want to come in, says the woman next door", "en")], "doc_id long, text string, lang string")
    odd.unionByName(extra, allowMissingColumns=True).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "the dog sleeps in the garden all day long and does not want to come in"), ("b", None), (None, "x y")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = check(spark, str(tmp_path))
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] == sizes[4] + 1


def test_empty_tables(spark, odd, tmp_path):
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [c.split()[0] for c in bpe.RESULT.split(", ")]


def test_schemas(spark, sf, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "contamination", "token_ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
    wide = docs.withColumn("found", F.lit(1)).withColumn("letters", F.lit("x"))
    assert corpus_pipeline.STAGES[0][1](spark, wide, sf).columns == wide.columns
    assert corpus_pipeline.STAGES[3][1](spark, wide, sf).columns == wide.columns
