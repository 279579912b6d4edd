"""Relational counterparts of distributed-training bookkeeping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_buckets(sizes: Iterable[tuple[int, int]], most: float) -> list[tuple[int, int]]:
    """(index, bucket) of (index, bytes) in order; a bucket closes before it would exceed `most`."""
    out, bucket, held = [], 0, 0
    for index, size in sizes:
        if held and held + size > most:
            bucket, held = bucket + 1, 0
        out.append((index, bucket))
        held += size
    return out


def owner(index: Column, world: int) -> Column:
    """The rank that owns a parameter."""
    return F.pmod(index, F.lit(world)).cast("int")


def allreduce_mean(grads: DataFrame, by: list[str], column: str) -> DataFrame:
    return grads.groupBy(*by).agg(F.avg(column).alias(column))
