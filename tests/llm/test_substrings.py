import hashlib
import random

import numpy as np
import pytest

from lexmill.llm import substrings


def brute(rows, length=substrings.LENGTH):
    """(doc_id, text) -> (n_bytes, n_removed, n_spans, sha256), straight from the definition."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, out = set(), {}
    for none, d, t in order:
        raw, gone = t.encode(), np.zeros(len(t.encode()) + 1, bool)
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(int)) == 1))
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[None if none else d, t] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def compare(df, **options):
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = substrings.remove_repeats(df, **options).collect()
    assert len(got) == df.count()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(r.doc_id), *want[r.doc_id, r.text or ""]) for r in df.collect())


def test_against_definition(docs):
    compare(docs)


def test_odd_rows(odd, none):
    compare(odd)
    assert substrings.remove_repeats(none).count() == 0


def test_runs_and_overlaps(spark):
    rows = [(1, "a" * 350), (2, "b" * 99 + "a" * 101 + "c"), (3, "ab" * 120), (4, "é" * 130 + "x"), (5, "x" + "é" * 130)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("seed", range(25))
def test_transform_against_sets(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(substrings, "LENGTH", length := rng.choice([3, 5, 8, 20]))
    letters = rng.choice([b"a", b"ab", b"abcdef"])
    parts = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 60))) for _ in range(rng.randint(1, 12))]
    rank = np.array(rng.sample(range(len(parts)), len(parts)))
    seen, want = set(), {}
    for i in np.argsort(rank):
        flags = []
        for k in range(len(parts[i])):
            w = parts[i][k : k + length]
            flags.append(len(w) == length and w in seen)
            seen.add(w)
        want[i] = flags
    got = substrings.repeated_windows(parts, rank)
    assert [g.tolist() for g in got] == [want[i] for i in range(len(parts))]


def test_filter_cuts_whole_characters(odd):
    kept = substrings.drop_repeats(odd)
    assert kept.columns == odd.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 6 not in texts and texts[2] is None and texts[8] == " tail" or "common59 tail" in texts[8]


def test_passage_in_most_documents(spark):
    """A hot passage, in equal and in differing surroundings: small flushes and transforms, few and many partitions."""
    rng = random.Random(7)
    passage = " ".join(f"licence{i}" for i in range(30))
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(k, own(rng.randrange(0, 200)) + passage + own(rng.randrange(0, 200))) for k in range(150)]
    rows += [(1000 + k, "same start of the footer, " * 2 + passage) for k in range(40)] + [(7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compare(df, chunk=2000, flush=500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        compare(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_halves_cover_all_windows():
    rng = random.Random(2)
    for _ in range(200):
        w = rng.randrange(1, substrings.LENGTH - substrings.GRAM + 2)
        anchor = rng.randrange(w - 1, substrings.LENGTH - substrings.GRAM + 1)
        text = bytes(rng.randrange(256) for _ in range(w + substrings.LENGTH - 1))
        got = substrings.halves(text, anchor, 0, w)
        assert sorted(k for _, a, n in got for k in range(a, a + n)) == list(range(w))
        assert all(side in text[k : k + substrings.LENGTH] and len(side) == substrings.SIDE for side, a, n in got for k in range(a, a + n))
