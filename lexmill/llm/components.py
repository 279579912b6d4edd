"""Connected components as joins: no edge or label leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, thrifty

FEW = 1 << 14  # pairs that one task joins at once: more rounds would only cost the driver stages


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, label) for all pairs of the batches."""
    parent: dict[int, int] = {}
    of_group: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for group, nid in zip(batch["group"].to_pylist(), batch["nid"].to_pylist(), strict=True):
            parent.setdefault(nid, nid)
            parent[root(nid)] = root(of_group.setdefault(group, nid))
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], names=["nid", "label"])


def components(members: DataFrame) -> DataFrame:
    """(nid, label) for (group, nid) pairs: nodes that share a group share a label, one of theirs.

    Every round each node takes the first node of its groups, in an order drawn
    anew, as its label; nodes of a label become one, and groups of one label are
    done. So a round only reads what is still open, which shrinks geometrically,
    long chains too, and with it the tasks that the driver has to follow.
    Aggregates are partial before they are shuffled. What is open is joined by one
    task once it is `FEW` pairs at most, whatever the input. Then the labels of the
    rounds are followed from the last, the shortest, on.
    """
    live, steps = members.select("group", "nid"), []
    while True:
        first = F.min(F.struct(F.xxhash64("nid", F.lit(len(steps))).alias("h"), "nid")).alias("first")
        taken = live.join(live.groupBy("group").agg(first), "group").groupBy("nid").agg(F.min("first").alias("first"))
        step = packed(cut(taken.select("nid", F.col("first.nid").alias("label"))))
        steps.append(step)
        merged = live.join(step, "nid").select("group", F.col("label").alias("nid"))
        still_open = merged.groupBy("group").agg(F.min("nid").alias("a"), F.max("nid").alias("b")).filter("a < b").select("group")
        live = packed(cut(merged.join(still_open, "group", "left_semi").distinct()))
        if (left := live.count()) <= FEW:
            break
    if left:
        steps.append(cut(live.coalesce(1).mapInArrow(thrifty(_together), "nid long, label long")))
    labels = steps.pop()
    while steps:
        end = labels.select(F.col("nid").alias("label"), F.col("label").alias("end"))
        labels = packed(cut(steps.pop().join(end, "label", "left").select("nid", F.coalesce("end", "label").alias("label"))))
    return labels
