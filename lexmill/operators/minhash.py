"""MinHash signatures (numpy on Arrow batches), banding and greedy keep-first resolution.

Two variants: `pkg` (word 3-grams, none for shorter texts, so those look alike)
and `strict` (word k-grams, a shorter text is one shingle). A band hit is a
duplicate; verification by exact Jaccard similarity is an option.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..functions.text import words
from ..session import cut
from .dedup import exact_dedup

PRIME = 2147483647


def coefficients(k: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each permutation, from one linear rule."""
    return [((1103515245 * (i + 1) + 12345) % PRIME, (69069 * (i + 1) + 1) % PRIME) for i in range(k)]


def shingles(ws: Column, k: int, short: bool = True) -> Column:
    """Distinct k-grams of an array of words; short: fewer words are one shingle."""
    last = F.size(ws) - k
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(ws, i + 1, k), " ")))
    return grams if short else F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def shingled(docs: DataFrame, k: int, short: bool = True) -> DataFrame:
    return docs.select("doc_id", words(F.lower("text")).alias("ws")).select("doc_id", shingles(F.col("ws"), k, short).alias("shingles"))


def _hashes(text: str | None, k: int, short: bool) -> np.ndarray:
    """28-bit hashes of the shingles of a lower-case text; str.split knows the white space of `words`."""
    ws = [] if text is None else text.split()
    if text is None or len(ws) < k and not short:
        return np.empty(0, np.int64)
    raw = " ".join(ws).encode()
    spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).tolist()
    ends = [*spaces, len(raw)][min(k, max(len(ws), 1)) - 1 :]
    digests = b"".join([hashlib.md5(raw[x:y], usedforsecurity=False).digest() for x, y in zip([0, *(s + 1 for s in spaces)], ends, strict=False)])
    return (np.frombuffer(digests, ">u4")[::4] >> 4).astype(np.int64)


def _minima(texts: list[str | None], rules: list[tuple[int, int]], k: int, short: bool) -> np.ndarray:
    """A row of minima of (h a + b) mod PRIME for each text; PRIME where there is no shingle."""
    out = np.full((len(rules), len(texts)), PRIME, np.int64)

    def settle(rows: list[int], parts: list[np.ndarray]) -> None:
        h, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
        v, high = np.empty_like(h), np.empty_like(h)
        for i, (a, b) in enumerate(rules):
            np.multiply(h, a, out=v)
            np.add(v, b, out=v)
            np.right_shift(v, 31, out=high)  # PRIME is 2^31 - 1: high and low bits add up to the same remainder, below 2 PRIME
            np.bitwise_and(v, PRIME, out=v)
            np.add(v, high, out=v)
            low = v.astype(np.uint32)
            np.minimum(low, low - np.uint32(PRIME), out=low)  # what is below PRIME wraps around
            out[i, rows] = np.minimum.reduceat(low, starts)

    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        if len(h := _hashes(text, k, short)):
            rows.append(row)
            parts.append(h)
            held += len(h)
        if held >= 1 << 14:
            settle(rows, parts)
            rows, parts, held = [], [], 0
    if rows:
        settle(rows, parts)
    return np.ascontiguousarray(out.T)


def signatures(docs: DataFrame, num_perm: int, k: int, short: bool = True) -> DataFrame:
    """(doc_id, sig): minima of (h a + b) mod p over 28-bit hashes of the shingles, a row for each row, without a shuffle."""
    rules = coefficients(num_perm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _minima(batch["text"].to_pylist(), rules, k, short)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, num_perm, np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sig], names=["doc_id", "sig"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, StructType([docs.schema["doc_id"], StructField("sig", ArrayType(LongType()))]))


def buckets(docs: DataFrame, bands: int, rows: int, k: int, short: bool = True) -> DataFrame:
    """(doc_id, digest, keys): the digest of the text and of each band of its signature, without a shuffle."""
    rules = coefficients(bands * rows)  # what is beyond the bands is never compared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = _minima(batch["text"].to_pylist(), rules, k, short)
            keys = [[hashlib.md5(bytes([i]) + sig[i * rows : (i + 1) * rows].tobytes(), usedforsecurity=False).digest() for i in range(bands)] for sig in sigs]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], pa.array(keys, pa.list_(pa.binary()))], names=["doc_id", "digest", "keys"])

    own = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.lower("text").alias("text"))
    return own.mapInArrow(run, StructType([docs.schema["doc_id"], StructField("digest", BinaryType()), StructField("keys", ArrayType(BinaryType()))]))


def banded(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    return sigs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.md5(F.array_join(F.slice("sig", i * rows + 1, rows), ",").cast("binary")).alias("key")))).alias("b")).select("doc_id", "b.band", "b.key")


def candidates(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(a, b), a < b, of documents that share a band.

    The contract of this operator is every pair of a bucket. Collapse exact copies
    first (see `keep_first`); buckets of near copies that are larger than a cluster
    can square belong to a class-based operator.
    """
    at = cut(banded(sigs, bands, rows))  # read three times
    shared = at.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key")
    left = at.join(shared, ["band", "key"], "left_semi")
    right = left.withColumnRenamed("doc_id", "b")
    return left.join(right, ["band", "key"]).filter(F.col("doc_id") < F.col("b")).select(F.col("doc_id").alias("a"), "b").distinct()


def greedy_drop(pairs: DataFrame) -> DataFrame:
    """Ids that a scan in id order drops: those with a kept earlier neighbour.

    Rounds of joins: a document with no undecided earlier neighbour and none kept
    is kept; one with a kept earlier neighbour is dropped. The least undecided id
    is decided each round.
    """
    pairs = cut(pairs)
    state = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.filter("kept is null").isEmpty():
        earlier = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("was")), "a")
        seen = earlier.groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("was", F.lit(False))).alias("hit"), F.max(F.col("was").isNull()).alias("open"))
        fresh = F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = cut(state.join(seen, "id", "left").select("id", F.coalesce("kept", fresh).alias("kept")))
    return state.filter("not kept").select("id")


def drop_in_buckets(members: DataFrame) -> DataFrame:
    """Ids that a scan in id order drops, from (doc_id, key) of the buckets: greedy_drop without pairs.

    The first of all its buckets is kept, and what shares a bucket with it is dropped; both go,
    and the rest is looked at again. Rows grow with documents, not with the square of a bucket.
    """
    members, dropped = cut(members), []
    while True:
        led = cut(members.join(members.groupBy("key").agg(F.min("doc_id").alias("first")), "key"))
        kept = cut(led.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") == F.col("first")).alias("all")).filter("all").select(F.col("doc_id").alias("first")))
        dropped.append(cut(led.filter(F.col("first") < F.col("doc_id")).join(kept, "first", "left_semi").select("doc_id").distinct()))
        members = cut(led.join(kept.select(F.col("first").alias("doc_id")).union(dropped[-1]), "doc_id", "left_anti").select("doc_id", "key"))
        if members.isEmpty():
            return reduce(DataFrame.union, dropped)


def keep_first(docs: DataFrame, num_perm: int, bands: int, rows: int, k: int, short: bool = True, verify: float | None = None) -> DataFrame:
    """doc_id of kept documents. Equal texts are resolved before anything is compared."""
    if verify is None:
        firsts = cut(exact_dedup(buckets(docs, bands, rows, k, short), F.col("digest")).select("doc_id", "keys"))
        members = firsts.filter("doc_id is not null").select("doc_id", F.explode("keys").alias("key"))
        shared = members.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key")
        dropped = drop_in_buckets(members.join(shared, "key", "left_semi").distinct())
        return firsts.select("doc_id").join(dropped, "doc_id", "left_anti")
    firsts = cut(exact_dedup(docs.select("doc_id", "text")))
    pairs = candidates(signatures(firsts, num_perm, k, short), bands, rows)
    sets = shingled(firsts, k, short)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    pairs = both.filter(F.size(F.array_intersect("x", "y")) >= verify * F.size(F.array_union("x", "y"))).select("a", "b")
    return firsts.select("doc_id").join(greedy_drop(pairs).withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")
