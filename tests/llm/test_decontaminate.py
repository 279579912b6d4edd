import hashlib
import random
import re
import time

from lexmill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, window=8):
    w = low(text)
    hit, names = set(), set()
    for name, item in items:
        t = low(item)
        n = min(window, len(t))
        wanted = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)} if t else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wanted:
                hit |= set(range(k, k + n))
                names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2


def brute_longest(text, items, window=8):
    """(words, place) of the longest run that a text shares with an item from a place at which a window stands."""
    w, best = low(text), (0, None)
    texts = [low(item) for _, item in items]
    for k in range(len(w)):
        runs = []
        for t in texts:
            for j in range(len(t)):
                m = 0
                while k + m < len(w) and j + m < len(t) and w[k + m] == t[j + m]:
                    m += 1
                runs.append((m, min(window, len(t)) if len(t) - j >= min(window, len(t)) else 0))
        stands = max((n for m, n in runs if n and m >= n), default=0)
        if stands and max(m for m, _ in runs) > best[0]:
            best = max(m for m, _ in runs), k
    return best


def check(df, bench, **options):
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None]
    want = sorted((str(r.doc_id), *brute(r.text, items)) for r in df.select("doc_id", "text").collect())
    got = decontaminate.benchmark_overlap(df, bench, **options).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    return {r.doc_id: r for r in got}


def test_against_definition(spark, sf, docs):
    got = check(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert any(r.n_items for r in got.values())


def test_blocks_add_up(spark, sf, docs):
    """A benchmark in many blocks gives what one block gives, in every column."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = check(docs, bench)
    assert whole == check(docs, bench, block_words=300)
    gone = lambda n: {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontaminate.remove_contaminated(docs, bench, block_words=n).collect()}
    assert gone(300) == gone(1 << 20) == {i for i, r in whole.items() if r.n_items >= 2 or r.longest_match >= 13}


def test_longest_matches(spark):
    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(f"i{k}", draw(rng.randrange(1, 40))) for k in range(12)]
    rows = [(k, draw(rng.randrange(0, 120))) for k in range(60)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    for k, text in rows:
        n, at = brute_longest(text, items)
        assert (got[k].longest_match, got[k].longest_at) == (n, at), text
        if n:
            assert " ".join(low(text)[at : at + n]) in " ".join(low(dict(items)[got[k].longest_item]))


def test_repetitive_text_and_item(spark):
    """Equal words in text and item: work by interval, not by pair."""
    n = 100_000
    df = spark.createDataFrame([(1, "word " * n), (2, "word " * 7), (3, "Word, word " * 30 + "x")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "word " * n), ("b", "word " * 12), ("c", "word " * 3)], "item_id string, text string")
    began = time.time()
    got = {r.doc_id: r for r in decontaminate.benchmark_overlap(df, bench).collect()}
    assert time.time() - began < 120
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].longest_match) == (n, n, 3, n)
    assert (got[2].n_hit, got[2].n_items) == (7, 1) and (got[3].n_hit, got[3].longest_match, got[3].longest_at) == (60, 60, 0)
    assert {r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()} == {2}


def test_short_items_alone_remove_nothing(spark):
    df = spark.createDataFrame([(1, "garden " * 3), (2, "one two three four five six seven eight nine and more"), (3, "one two three four five six seven eight")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "garden"), ("b", "one two three four five six seven eight nine")], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()} == {1, 3}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the CAT are in the garden the dog and more"), (2, "Garden"), (2, "Garden"), (3, None), (4, "..."), (None, "dog"), (5, "und die katze"), (6, "common3 common4 common5 common6 common7 common8 common9 common10 common11 common12 common13 common14 common15 common16")], "item_id long, text string")
    got = check(odd, bench)
    assert got[8].n_hit == 14 and got[8].longest_match == 14
    assert decontaminate.benchmark_overlap(none, bench).count() == 0
    assert decontaminate.benchmark_overlap(odd, bench.limit(0)).filter("n_items > 0").isEmpty()
    kept = {r.doc_id for r in decontaminate.remove_contaminated(odd, bench).collect()}
    assert 8 not in kept and {2, 3, 7, None} <= kept
