from itertools import pairwise

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexmill.operators import dedup, minhash


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


LINES = [(1, "same\nsame too\n"), (2, "same\nsame too\n"), (3, "- home\n- back\n- menu\npage three\n"), (4, "- home\n- menu\npage four\n"), (5, "alone\n")]


def test_line_dedup_keeps_emptied_documents(spark):
    got = dict(dedup.line_dedup(docs(spark, LINES)).collect())
    assert got == {1: "", 2: "", 3: "- back\npage three", 4: "page four", 5: "alone"}


def test_exact_dedup_keeps_first(spark):
    assert {r.doc_id for r in dedup.exact_dedup(docs(spark, [(3, "a"), (1, "a"), (2, "b"), (4, "b")])).collect()} == {1, 2}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 12)), max_size=20))
def test_greedy_drop_is_a_scan_in_order(spark, raw):
    pairs = sorted({(min(p), max(p)) for p in raw if p[0] != p[1]})
    near, kept, dropped = {}, set(), set()
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for x in sorted(near):
        (dropped if near[x] & kept else kept).add(x)
    got = {r.id for r in minhash.greedy_drop(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dropped


def test_near_copies_collapse(spark):
    base = [f"word{i}" for i in range(160)]
    near = [*base[:80], "changed", *base[81:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(reversed(base))), (4, " ".join(base))]
    kept = {r.doc_id for r in minhash.keep_first(docs(spark, rows), 100, 20, 5, 5, verify=0.8).collect()}
    assert kept == {1, 3}


def test_short_texts_by_variant(spark):
    rows = [(1, "two words"), (2, "other text")]
    strict = minhash.shingled(docs(spark, rows), 5).collect()
    assert {tuple(r.shingles) for r in strict} == {("two words",), ("other text",)}
    assert all(r.shingles == [] for r in minhash.shingled(docs(spark, rows), 3, short=False).collect())
    assert {r.doc_id for r in minhash.keep_first(docs(spark, rows), 16, 4, 4, 3, short=False).collect()} == {1}


def test_coefficients_are_distinct():
    rules = minhash.coefficients(128)
    assert len(set(rules)) == 128 and all(0 < a < minhash.PRIME for a, _ in rules) and all(x != y for x, y in pairwise(rules))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 6)), max_size=24))
def test_drop_in_buckets_is_a_scan_in_order(spark, raw):
    at = set(raw)
    near = {x: {y for k in {k for i, k in at if i == x} for y, j in at if j == k and y != x} for x, _ in at}
    kept = set()
    for x in sorted(near):
        kept |= {x} - set().union(*(near[y] for y in kept))
    got = {r.doc_id for r in minhash.drop_in_buckets(spark.createDataFrame(sorted(at), "doc_id long, key long")).collect()}
    assert got == set(near) - kept


def test_a_large_bucket_is_not_squared(spark, monkeypatch):
    """Texts without a shingle share all buckets; ids null and repeated, null and equal texts included."""
    monkeypatch.setattr(minhash, "candidates", None)
    rows = [*((i, f"w{i}") for i in range(2, 900)), (1, " ".join("abcdefgh")), (None, "w2"), (None, "none"), (1000, None), (1, "w1"), (1001, " ".join("abcdefgh"))]
    got = [r.doc_id for r in minhash.keep_first(docs(spark, rows), 16, 4, 4, 3, short=False).collect()]
    assert sorted(got, key=str) == [1, 1, None]


def test_signatures_equal_their_definition(spark):
    import hashlib

    texts = ["", "One", "a b c d e f g h", "É Ü　x Y\x1cz W q r", " ".join(f"w{i % 701}" for i in range(20_000)), None]
    for k, short in ((3, False), (5, True)):
        got = {r.doc_id: r.sig for r in minhash.signatures(docs(spark, list(enumerate(texts))), 20, k, short).collect()}
        for i, t in enumerate(texts):
            ws = (t or "").lower().split()
            grams = {" ".join(ws[j : j + k]) for j in range(max(len(ws) - k + 1, 1))} if t is not None and (short or len(ws) >= k) else ()
            hs = [int(hashlib.md5(g.encode()).hexdigest()[:7], 16) for g in grams]
            assert got[i] == [min(((h * a + b) % minhash.PRIME for h in hs), default=minhash.PRIME) for a, b in minhash.coefficients(20)]


def test_strict_buckets_drop_what_pairs_drop(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    firsts = dedup.exact_dedup(rows)
    pairs = minhash.candidates(minhash.signatures(firsts, 100, 5), 8, 12)
    dropped = {r.id for r in minhash.greedy_drop(pairs).collect()}
    monkeypatch.setattr(minhash, "candidates", None)
    got = {r.doc_id for r in minhash.keep_first(rows, 100, 8, 12, 5).collect()}
    assert dropped and got == {r.doc_id for r in firsts.collect()} - dropped


def test_the_near_plan_makes_no_pairs(spark, monkeypatch):
    from lexmill.plans import clean

    monkeypatch.setattr(minhash, "candidates", None)
    rows = [*((i, f"w{i}") for i in range(500)), (500, "w3"), (501, "one two three four"), (502, "one two three four")]
    got = clean.run(docs(spark, rows), ("dedup",), near=True).collect()
    assert sorted(map(tuple, got)) == [(0, "w0"), (501, "one two three four")]
