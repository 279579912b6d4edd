"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups go, largest
first, to the least-loaded shard through a heap. The heap runs over *cells*, not
groups: groups of one size class (12 significant bits of their bytes) are
alike, so a cell is "so many groups of this class", and the driver hands out
counts. Groups larger than 1/(50 x shards) of everything - at most 50 x shards
exist - are scheduled one by one at their exact size. The driver therefore sees
a number of rows bounded by the size classes (under 100,000 for any input) plus
one cell for each 50,000 groups of a crowded class, never the groups themselves.

Cases: a null text counts as empty (and shares the group of empty texts);
repeated rows are rows of one group; rows with a null doc_id are sharded like
others; an empty table gives an empty result; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_parts

ROW_BYTES = 16  # added to each row's size
CELL_GROUPS = 50_000  # groups of one class that one task ranks
BITS = 12  # of a size that count


def size_class(size: str):
    """The size with all but its highest BITS bits cleared."""
    drop = f"cast(greatest(0, length(bin({size})) - {BITS}) as int)"
    return F.expr(f"shiftleft(shiftright({size}, {drop}), {drop})")


def schedule(cells: list[tuple], shards: int) -> list[tuple]:
    """LPT over cells (key, size of a group, groups): [(key, [(first rank, shard), ...])].

    Cells come in any order and are taken by falling size. A cell of many
    equal groups is poured in as the heap would place them one by one.
    """
    heap = [(0.0, s) for s in range(shards)]
    plan = []
    for key, size, n in sorted(cells, key=lambda c: (-c[1], c[0])):
        given = dict.fromkeys(range(shards), 0)
        if n > 4 * shards:  # lift all shards to the highest level that takes fewer than n
            low, high = heap[0][0], heap[0][0] + size * (n + 1)
            for _ in range(60):
                mid = (low + high) / 2
                if sum(max(0, int((mid - load) // size)) for load, _ in heap) <= n:
                    low = mid
                else:
                    high = mid
            for load, s in heap:
                given[s] = max(0, int((low - load) // size))
            n -= sum(given.values())
            heap = [(load + given[s] * size, s) for load, s in heap]
            heapq.heapify(heap)
        for _ in range(n):
            load, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        at, ranges = 0, []
        for s, k in given.items():
            if k:
                ranges.append((at, s))
                at += k
        plan.append((key, ranges))
    return plan


def lpt_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("gk"),
    )
    groups = cut(rows.groupBy("gk").agg(F.sum("size").alias("gsize")))
    whole = groups.agg(F.sum("gsize")).first()[0] or 0
    large = max(1, whole // (50 * shards))
    # one value of `lone` for each group beyond `large`: they are scheduled singly
    classed = groups.withColumn("class", size_class("gsize")).withColumn("lone", F.when(F.col("gsize") > large, F.hex("gk")).otherwise(""))
    counts = classed.groupBy("class", "lone").agg(F.count("*").alias("n"), F.sum("gsize").alias("bytes")).collect()
    crowded = {r["class"]: -(-r["n"] // CELL_GROUPS) for r in counts if r["n"] > CELL_GROUPS}
    if crowded:
        salts = spark.createDataFrame(sorted(crowded.items()), "class long, salts long")
        classed = classed.join(F.broadcast(salts), "class", "left").withColumn("salt", F.pmod(F.xxhash64("gk"), F.coalesce("salts", F.lit(1))))
        counts = classed.groupBy("class", "lone", "salt").agg(F.count("*").alias("n"), F.sum("gsize").alias("bytes")).collect()
    else:
        classed = classed.withColumn("salt", F.lit(0).cast("long"))
    cells = [((r["class"], r["lone"], r["salt"] if crowded else 0), r["bytes"] / r["n"], r["n"]) for r in counts]
    plan = [(*key, ranges) for key, ranges in schedule(cells, shards)]
    places = spark.createDataFrame(plan, "class long, lone string, salt long, ranges array<struct<first: long, shard: int>>")
    rank = F.row_number().over(Window.partitionBy("class", "lone", "salt").orderBy("gk")) - 1
    placed = (
        classed.withColumn("rank", rank)
        .join(F.broadcast(places), ["class", "lone", "salt"])
        .select("gk", F.element_at(F.filter("ranges", lambda x: x["first"] <= F.col("rank")), -1)["shard"].alias("shard"))
    )
    sharded = cut(rows.join(placed, "gk").select("doc_id", "size", "text_crc32", "shard"))
    # slots: rank inside (shard, strip) plus the rows of the strips before; a strip is one task's share
    strips = max(8, shuffle_parts(spark))
    striped = sharded.withColumn("strip", F.pmod(F.monotonically_increasing_id(), F.lit(strips)))
    sizes = striped.groupBy("shard", "strip").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "strip", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "strip").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        striped.withColumn("within", within)
        .join(F.broadcast(starts), ["shard", "strip"])  # shards x strips rows, both parameters
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
