import heapq
import random
import zlib

from lexmill.llm import sharding


def check(df, shards=40):
    rows = sharding.lpt_shards(df, shards).collect()
    texts = df.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in texts)
    slots: dict = {}
    groups: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    load = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    return load, rows


def test_documents(docs):
    load, rows = check(docs, 8)
    assert max(load) - min(load) <= max(r.size for r in rows)


def test_against_lpt_of_groups(docs):
    """Size classes cost next to nothing against true LPT over the groups themselves."""
    for shards in (5, 40):
        load, rows = check(docs, shards)
        groups: dict = {}
        for r in rows:
            groups[r.size, r.text_crc32] = groups.get((r.size, r.text_crc32), 0) + r.size
        heap = [0] * shards
        for size in sorted(groups.values(), reverse=True):
            heapq.heapreplace(heap, heap[0] + size)
        assert max(load) <= max(heap) * (1 + 2.0 ** (1 - sharding.BITS)) + 1


def test_odd_rows(odd, none):
    check(odd)
    assert sharding.lpt_shards(none).count() == 0


def test_crowded_classes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_GROUPS", 20)
    df = spark.range(3000).selectExpr("id as doc_id", "concat('t', lpad(cast(id as string), 6, '0')) as text")
    load, _ = check(df, 7)
    assert max(load) - min(load) <= 23


def test_schedule_is_one_by_one():
    rng = random.Random(2)
    for _ in range(30):
        cells = [(i, s, rng.choice([1, 2, 30, 400])) for i, s in enumerate(rng.sample(range(1, 5000), 12))]
        plan = dict(sharding.schedule(cells, 5))
        got = [0] * 5
        for key, size, n in cells:
            edges = [*plan[key], (n, None)]
            for (a, s), (b, _) in zip(edges, edges[1:], strict=False):
                got[s] += (b - a) * size
        heap = [0] * 5
        for _, size, n in sorted(cells, key=lambda c: -c[1]):
            for _ in range(n):
                heapq.heapreplace(heap, heap[0] + size)
        assert sorted(got) == sorted(heap)
