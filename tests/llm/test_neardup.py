import random
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import components, neardup
from tests.llm.test_decontaminate import low


def weights(text):
    w = low(text)
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def direct(a, b):
    """The definition of probability Jaccard similarity."""
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in set(a) & set(b))


@pytest.mark.parametrize("seed", range(20))
def test_similarity_is_the_definition(seed):
    rng = random.Random(seed)
    a, b = ({rng.randint(1, 12): rng.randint(1, 5) for _ in range(8)} for _ in range(2))
    assert neardup.similarity(a, b) == pytest.approx(direct(a, b))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = {int(x): int(w) for x, w in zip(rng.integers(1, 1 << 60, 300), rng.integers(1, 6, 300), strict=True)}
    b = dict(list(a.items())[:240]) | {int(x): 2 for x in rng.integers(1, 1 << 60, 60)}
    row = np.repeat([0, 1], [len(a), len(b)])
    sig = neardup.probminhash(row, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2000)
    assert abs((sig[0] == sig[1]).mean() - neardup.similarity(a, b)) < 0.04


def classes(df, threshold=0.8):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    texts = sorted({t for _, t in rows if t is not None})
    ws = [weights(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if set(ws[i]) & set(ws[j]) and direct(ws[i], ws[j]) >= threshold:
                label = [label[j] if x == label[i] else x for x in label]
    of = {t: label[i] for i, t in enumerate(texts)}
    least: dict = {}
    for d, t in rows:
        if t is not None and d is not None:
            least[of[t]] = min(d, least.get(of[t], d))
    return sorted(str((d, d if t is None else least.get(of[t]))) for d, t in rows)


def test_against_all_pairs(docs):
    assert sorted(str((r.doc_id, r.class_id)) for r in neardup.near_duplicates(docs).collect()) == classes(docs)


def test_chains_and_hot_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(60):  # ever more changed words: some reach the base, some each other, some none
        words = list(base)
        for i in rng.sample(range(120), k // 6):
            words[i] = f"c{k}x{i}"
        rows.append((100 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str((r.doc_id, r.class_id)) for r in neardup.near_duplicates(df).collect()) == classes(df)


def test_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert sorted(str((r.doc_id, r.class_id)) for r in got) == classes(odd)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "None", "3", "4", "5", "7", "8", "9", "10"])
    assert all(r.is_first for r in got if r.doc_id == 5) and not any(r.is_first for r in got if r.doc_id == 6)


def test_group_held_together_by_chains(spark, monkeypatch):
    """A long chain of overlapping texts is one group of candidates; its pairs are taken band by band."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    words = [f"w{i}" for i in range(1200)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 110])) for k in range(90)]
    rows += [(1000 + k, " ".join(words[240 + k : 350 + k])) for k in range(4)]  # really alike
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str((r.doc_id, r.class_id)) for r in neardup.near_duplicates(df).collect()) == classes(df)


def test_clashing_names(odd):
    other = odd.withColumnsRenamed({"size": "at", "shard": "by"})
    assert neardup.keep_first(other).columns == other.columns and neardup.near_duplicates(other).count() == other.count()


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components_follow_only_what_is_open(spark, monkeypatch, few):
    """Groups of one label leave the rounds: tasks, and what the driver keeps of them, do not grow with rounds times nodes."""
    pairs = [(k, x) for k in range(500) for x in (2 * k, 2 * k + 1)]
    chain = [(1000 + k, x) for k in range(40) for x in (2000 + k, 2001 + k)]
    read = []

    def counted(df):
        out = neardup.cut(df)
        read.append(out.count())
        return out

    monkeypatch.setattr(components, "cut", counted)
    monkeypatch.setattr(components, "FEW", few)
    members = spark.createDataFrame(pairs + chain, "group long, nid long")
    label = {r.nid: r.label for r in components.components(members).collect()}
    assert len(label) == 1041 and all(label[label[x]] == label[x] for x in label)
    assert all(label[2 * k] == label[2 * k + 1] for k in range(500)) and len({label[x] for x in range(2000, 2041)}) == 1
    assert len(set(label.values())) == 501
    assert sum(read) < 3 * len(label)
    assert components.components(members.limit(0)).count() == 0


def test_small_parts_are_read_together(spark):
    """The driver follows tasks by the bytes there are, not by the parts that happened to write them, and loses no row."""
    context, was = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    members = spark.createDataFrame([(k // 2, k + k % 2) for k in range(2000)], "group long, nid long")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        context.setJobGroup("parts", "parts")
        label = {r.nid: r.label for r in components.components(members).collect()}
    finally:
        context._jsc.clearJobGroup()
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("parts") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(tracker.getStageInfo(s).numCompletedTasks for s in stages)
    nodes = {k + k % 2 for k in range(2000)}
    assert set(label) == nodes and all((label[k] == label[k + 1 + (k + 1) % 2]) for k in range(0, 2000, 2))
    assert 0 < tasks < 620
