"""Near-duplicates by ProbMinHash, banding and verification.

A text is its word shingles (five words, A-Z lower-cased; a shorter text is one
shingle), weighted by how often each occurs. The similarity of two texts is the
probability Jaccard similarity of those weights, estimated by ProbMinHash: each
shingle sends exponential arrivals at a rate equal to its weight to random
registers, each register keeps the shingle that came first, and a shingle stops
sending once its next arrival is later than every register's first. All shingles
of all texts of a batch take their k-th step together.

1. Equal texts are collapsed to one node by hash.
2. Registers are cut into bands; nodes that share a band are candidates, and the
   connected groups of candidates are found without naming pairs.
3. The node of a group that shares most bands with others is its centre. Every
   member is compared with the centre exactly; those at or above the threshold
   are settled.
4. What is not settled is compared exactly with the nodes that share a band with it,
   band by band, bands with the same nodes once; or, where that names more pairs
   than the group has, with all other members of its group. So a group that only
   hangs together by chains of bands costs what its bands cost. This is done
   in blocks of `BLOCK` nodes: a pair of blocks is one task's work. Inside, a
   prefix filter on rare shingles leaves out pairs that cannot reach the
   threshold, and pairs already connected are skipped. Only links come out, at
   most one for each node of a block. Settled nodes need not be compared with
   each other: they are connected.
5. Links are closed into classes.

So hot groups are split into block pairs, no list of pairs or links is gathered,
and no candidate is dropped.

Cases: a null text is a class of its own; texts without words are only alike if
equal; repeated rows belong to their text's class, and if one of them is its first
all are (keep_first keeps one); a null doc_id is carried;
the class id is the least doc_id of the class (null only if all are null);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE_A, BASE_B, MIX_1, U64, buffers, mix, pieces, span_hashes, words
from .common import cut, fresh, packed, release_memory, shuffle_parts, text_key, thrifty
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 7  # a pair at the threshold shares a band with probability 0.997
BLOCK, BLOCK_BYTES = 100, 1 << 20
NO_ID = -(1 << 63)
PIECE = 1 << 20


def shingles(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, shingle hash, weight) of the distinct shingles of some rows at a time; rows ascending."""
    raw, offsets = buffers(column)
    for i, j in pieces(offsets, PIECE):
        low, starts, ends, first = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h = np.concatenate((span_hashes(low, starts, ends, BASE_A), np.zeros(k, U64)))
        count = np.diff(first)
        row = np.repeat(np.arange(j - i), count)
        left = np.repeat(first[1:], count) - np.arange(len(starts))
        own = np.repeat(np.minimum(count, k), count)
        at = np.flatnonzero(left >= own)
        value = np.zeros(len(at), U64)
        with np.errstate(over="ignore"):
            for d in range(k):
                value = np.where(own[at] > d, mix(value * MIX_1 + h[at + d] + U64(d + 1)), value)
        order = np.lexsort((value, row[at]))
        r, v = row[at][order], value[order]
        new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))) if len(r) else np.zeros(0, bool))
        yield i + r[new], v[new], np.diff(np.concatenate((new, [len(r)])))


def probminhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """Signatures of rows 0..max(row): the element that reached each register first (0: none)."""
    n = int(row.max()) + 1 if len(row) else 0
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, U64)
    time = np.zeros(len(row))
    live, step = np.arange(len(row)), 0
    while len(live):
        with np.errstate(over="ignore"):
            h = mix(element[live] + U64(2 * step + 1) * BASE_B)
            place = (mix(h ^ BASE_A) >> U64(11)).astype(np.float64) * 2.0**-53
        u = ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[live] -= np.log(u) / weight[live]
        slot = row[live] * registers + (place * registers).astype(np.int64)
        np.minimum.at(first, slot, time[live])
        won = first[slot] == time[live]
        winner[slot[won]] = element[live[won]]
        last = first.reshape(n, registers).max(axis=1)
        live = live[time[live] < last[row[live]]]
        step += 1
    return winner.reshape(n, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    value = np.zeros((len(signature), bands), U64) + np.arange(1, bands + 1, dtype=U64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            value = mix(value * BASE_A + signature[:, r : bands * rows : rows])
    return value.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, bands), np.int64)
            known = np.zeros(batch.num_rows, bool)
            for row, element, weight in shingles(batch["text"]):
                if len(row):
                    names, local = np.unique(row, return_inverse=True)
                    out[names] = band_hashes(probminhash(local, element, weight, bands * rows), bands, rows)
                    known[names] = True
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(known * bands))), pa.int32()), pa.array(out[known].ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tkey"], flat], names=["doc_id", "tkey", "bands"])

    return run


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Probability Jaccard similarity of two weightings.

    Sum over common d of 1 / sum over all e of max(a[e] / a[d], b[e] / b[d]).
    With the common elements sorted by the ratio a/b the inner maximum switches
    sides once, so one pass over prefix sums does.
    """
    common = [x for x in (a if len(a) <= len(b) else b) if x in a and x in b]
    if not common:
        return 0.0
    wa, wb = sum(a.values()), sum(b.values())
    p, q = np.array([a[x] for x in common], float), np.array([b[x] for x in common], float)
    if (p == 1).all() and (q == 1).all() and wa == len(a) and wb == len(b):
        return len(common) / (len(a) + len(b) - len(common))
    ratio = p / q
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    # e takes the side of a where a[e] / b[e] >= a[d] / b[d]; elements of one text only take its side
    cp, cq = np.concatenate(([0], np.cumsum(p))), np.concatenate(([0], np.cumsum(q)))
    at = np.searchsorted(ratio, ratio, "left")
    only_a, only_b = wa - p.sum(), wb - q.sum()
    return float((1 / ((only_a + cp[-1] - cp[at]) / p + (only_b + cq[at]) / q)).sum())


def _weights(column: pa.Array) -> list[dict[int, int]]:
    out: list[dict[int, int]] = [{} for _ in range(len(column))]
    for row, element, weight in shingles(column):
        cuts = np.searchsorted(row, np.arange(row[0] if len(row) else 0, (row[-1] if len(row) else -1) + 2))
        for k, i in enumerate(range(int(row[0]), int(row[-1]) + 1) if len(row) else ()):
            s = slice(cuts[k], cuts[k + 1])
            out[i] = dict(zip(element[s].tolist(), weight[s].tolist(), strict=True))
    return out


def links(docs: list[dict[int, int]], fresh: np.ndarray, left: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that connect all documents alike, of which at least one is fresh; not fresh ones are connected already.

    left: which of two sides a document is on; -1 means both (all pairs count).
    Two documents alike share a shingle in the rarest part of each that weighs
    more than 1 - threshold of it (same order in both), so only those meet.
    """
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    settled = [i for i in range(len(docs)) if not fresh[i]]
    for i in settled[1:]:
        parent[root(i)] = root(settled[0])
    often: dict[int, int] = defaultdict(int)
    for d in docs:
        for s in d:
            often[s] += 1
    found, meets = [], defaultdict(list)
    for i, d in enumerate(docs):
        room, prefix = (1 - threshold) * sum(d.values()) + 1e-9, []
        for s in sorted(d, key=lambda s: (often[s], s)):
            prefix.append(s)
            room -= d[s]
            if room < 0:
                break
        tried = set()
        for s in prefix:
            if often[s] < 2:
                continue
            for j in meets[s]:
                if j in tried or (left[i] == left[j] != -1) or not (fresh[i] or fresh[j]):
                    continue
                tried.add(j)
                a, b = root(i), root(j)
                if a != b and similarity(d, docs[j]) >= threshold:
                    parent[a] = b
                    found.append((i, j))
            meets[s].append(i)
    return found


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each distinct text (tkey): class_id, class_size, and the key of the class's first text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = source.select("doc_id", "text", text_key().alias("tkey"))
    signed = keyed.filter(F.col("text").isNotNull()).mapInArrow(thrifty(_sign(bands, rows)), "doc_id long, tkey binary, bands array<long>")
    # one node for each text; ids of rows read from the checkpoint are the same each time
    nodes = cut(signed.groupBy("tkey").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")))
    nodes = packed(cut(nodes.withColumn("nid", F.monotonically_increasing_id())))
    banded = nodes.select("nid", F.explode("bands").alias("group"))
    shared = banded.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    members = packed(cut(banded.join(shared, "group").select("group", "nid", "n")))
    candidates = components(members.select("group", "nid"))
    # the centre of a group: the node with most company in its bands
    company = members.groupBy("nid").agg(F.sum("n").alias("company"))
    ranked = candidates.join(company, "nid")
    centres = ranked.groupBy("label").agg(F.max(F.struct("company", F.negative("nid").alias("minus"))).alias("top")).select("label", (-F.col("top.minus")).alias("centre"))
    placed = packed(cut(ranked.join(centres, "label").join(nodes.select("nid", "tkey", "first"), "nid").select("nid", "tkey", "first", "label", "centre")))
    # the text of a node comes from its first document; copies stay where they are
    at_first = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("at")
    texts = packed(
        cut(
            keyed.select("tkey", at_first, "text")
            .join(placed.withColumn("at", F.coalesce("first", F.lit(NO_ID))), ["tkey", "at"])
            .dropDuplicates(["tkey", "at"])
            .select("nid", "label", "centre", "text", F.octet_length("text").cast("long").alias("bytes"))
        )
    )
    heart = texts.filter("nid = centre").select("label", F.col("text").alias("heart"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, {}
        for batch in batches:
            ok = []
            for i, j in pieces(buffers(batch["text"])[1], BLOCK_BYTES):  # weights take far more room than text
                for weights, text in zip(_weights(batch["text"].slice(i, j - i)), batch["heart"].slice(i, j - i).to_pylist(), strict=True):
                    if text != last:
                        last, known = text, _weights(pa.array([text], pa.string()))[0]
                    ok.append(similarity(weights, known) >= threshold)
            yield pa.RecordBatch.from_arrays([batch["nid"], batch["label"], batch["centre"], batch["bytes"], pa.array(ok, pa.bool_())], names=["nid", "label", "centre", "bytes", "settled"])

    judged = packed(cut(texts.join(heart, "label").mapInArrow(thrifty(compare), "nid long, label long, centre long, bytes long, settled boolean")))
    star = judged.filter("settled").select(F.col("label").alias("group"), "nid")
    # what is left: fresh nodes (f) and settled ones (s; connected already), in a whole group or in the bands that its
    # nodes share, whichever names fewer pairs; bands with the same nodes count once
    rest = judged.filter("not settled or nid <> centre").select("nid", "label", "settled", "bytes")
    is_fresh = ~F.col("settled")
    tally = lambda what, value, name: F.coalesce(F.sum(F.when(what, value)), F.lit(0)).alias(name)
    sizes_of = [tally(is_fresh, F.lit(1), "f"), tally(~is_fresh, F.lit(1), "s"), tally(is_fresh, F.col("bytes"), "f_bytes"), tally(~is_fresh, F.col("bytes"), "s_bytes")]
    pairs_of = (F.col("f") * (F.col("f") + F.col("s"))).cast("double")
    same_nodes = [F.bit_xor(F.xxhash64("nid")).alias("x"), F.sum(F.pmod(F.xxhash64("nid", F.lit(1)), F.lit(1 << 31))).alias("y")]
    in_bands = members.select("group", "nid").join(rest, "nid")
    shared_bands = in_bands.groupBy("label", "group").agg(*sizes_of, *same_nodes).filter("f > 0 and f + s > 1").groupBy("label", "x", "y", "f", "s").agg(F.min("group").alias("unit"), F.max("f_bytes").alias("f_bytes"), F.max("s_bytes").alias("s_bytes"))
    shared_bands = packed(cut(shared_bands.drop("x", "y")))
    groups = rest.groupBy("label").agg(*sizes_of).filter("f > 0 and f + s > 1")
    by_band = groups.join(shared_bands.groupBy("label").agg(F.sum(pairs_of).alias("pairs")), "label").filter(F.col("pairs") < pairs_of).select("label")
    kinds = ["by", "unit", "f", "s", "f_bytes", "s_bytes"]
    units = groups.join(by_band, "label", "left_anti").withColumns({"by": F.lit("group"), "unit": F.col("label")}).select(kinds).union(shared_bands.join(by_band, "label", "left_semi").withColumn("by", F.lit("band")).select(kinds))
    blocks_of = lambda n, size: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_BYTES)).cast("int")
    counts = units.select("by", "unit", blocks_of("f", "f_bytes").alias("fs"), blocks_of("s", "s_bytes").alias("ss"), ((F.col("f") + F.col("s") <= BLOCK) & (F.col("f_bytes") + F.col("s_bytes") <= BLOCK_BYTES)).alias("small"))
    placed_in = rest.select(F.lit("group").alias("by"), F.col("label").alias("unit"), "nid", "settled").union(in_bands.select(F.lit("band").alias("by"), F.col("group").alias("unit"), "nid", "settled"))
    deal = lambda n: F.pmod(F.xxhash64("nid"), F.greatest(F.col(n), F.lit(1))).cast("int")
    dealt = placed_in.join(counts, ["by", "unit"]).withColumn("block", F.when(F.col("settled"), deal("ss")).otherwise(deal("fs")))
    # a fresh block meets itself and the later fresh blocks (pair a <= b), and each settled block (pair a, -1 - b)
    small = F.col("small")
    all_of = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)))
    fresh_pairs = F.concat(
        F.transform(all_of("fs"), lambda o: F.struct(F.least(o, F.col("block")).alias("a"), F.greatest(o, F.col("block")).alias("b"))),
        F.when(F.col("ss") > 0, F.transform(all_of("ss"), lambda o: F.struct(F.col("block").alias("a"), (-1 - o).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>")),
    )
    settled_pairs = F.transform(all_of("fs"), lambda o: F.struct(o.alias("a"), (-1 - F.col("block")).alias("b")))
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    side = F.when(small, -1).when(F.col("settled"), 1).when(F.col("pair.a") == F.col("pair.b"), -1).when(F.col("pair.b") < 0, 0).otherwise((F.col("block") == F.col("pair.b")).cast("int"))
    work = dealt.withColumn("pair", F.explode(F.when(small, one).when(F.col("settled"), settled_pairs).otherwise(fresh_pairs))).select("nid", "by", "unit", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "settled", side.alias("side"))

    def block_links(table: pa.Table) -> pa.Table:
        table = table.sort_by("nid")
        weights = _weights(table["text"].combine_chunks())
        nid = table["nid"].to_numpy()
        found = links(weights, ~np.asarray(table["settled"].to_numpy(), bool), table["side"].to_numpy(), threshold)
        del weights
        release_memory()
        return pa.table([pa.array([nid[i] for i, _ in found], pa.int64()), pa.array([nid[j] for _, j in found], pa.int64())], names=["x", "y"])

    # dealt by number: few bytes, but much work, so that partitions are not to be merged by size
    pairs_of_blocks = work.join(texts.select("nid", "text"), "nid").repartition(shuffle_parts(docs.sparkSession), "by", "unit", "a", "b")
    linked = packed(cut(pairs_of_blocks.groupBy("by", "unit", "a", "b").applyInArrow(block_links, "x long, y long")))
    edges = linked.select((-1 - F.monotonically_increasing_id()).alias("group"), F.array("x", "y").alias("pair")).select("group", F.explode("pair").alias("nid"))
    # a class: what the stars (named by their label) and the links (numbered below 0) connect
    together = packed(cut(star.union(edges)))
    classes = components(together)
    named = nodes.select("nid", "tkey", "first").join(classes, "nid", "left").select("tkey", "first", F.coalesce("label", F.col("nid")).alias("label"))
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "tkey")).alias("low")
    of_text = named.join(named.groupBy("label").agg(least), "label").select("tkey", "label", F.col("low.first").alias("class_id"), F.col("low.tkey").alias("first_key"))
    sizes = keyed.filter("text is not null").groupBy("tkey").agg(F.count("*").alias("copies"))
    of_text = packed(cut(of_text.join(sizes, "tkey")))
    totals = of_text.groupBy("label").agg(F.sum("copies").alias("class_size"))
    return of_text.join(totals, "label").select("tkey", "class_id", "first_key", "class_size")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, is_first (the class's first text and id) for every row."""
    of_text = text_classes(docs, threshold, bands, rows)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tkey") == F.col("first_key"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"))
        .join(of_text, "tkey", "left")
        .select("doc_id", F.when(F.col("tkey").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce(first, F.lit(True)).alias("is_first"))
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class of near-duplicates, and every row without a text."""
    tkey, at = fresh(docs, "tkey", "at")
    firsts = text_classes(docs, threshold).filter(F.col("tkey") == F.col("first_key")).select(F.col("tkey").alias(tkey), F.coalesce("class_id", F.lit(NO_ID)).alias(at))
    keyed = docs.filter(F.col("text").isNotNull()).withColumn(tkey, text_key()).withColumn(at, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    kept = keyed.join(firsts, [tkey, at]).dropDuplicates([tkey, at]).select(*docs.columns)
    return kept.unionByName(docs.filter(F.col("text").isNull()))
