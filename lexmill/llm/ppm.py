"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes. The code length
of a byte is that of PPM with method-C escapes: in a context seen n times with q
different successors, a successor seen c times costs -log2(c / (n + q)) bits,
any other costs the escape -log2(q / (n + q)) and is coded in the context one
byte shorter; an unseen context costs nothing to leave; below the empty context
all 256 bytes are equally likely. Statistics are frozen after training. A text
gets the language that codes it in the fewest bits; the score compares the
languages by their bits a byte, so that it says how clear the case is whatever
the length: 2^-r / (sum of 2^-r over all languages), r being bits a byte.

The classifier is fitted on a bounded sample of labelled rows: of a language with
more than `sample_bytes` bytes of training text, documents are taken by a hash of
id and text so that about as many bytes remain, whole texts, and every context
in them counts; nothing is pruned. What the driver gathers is bounded by that
parameter and the number of languages, as is the model, which grows by
the contexts of each language (not by languages times contexts). Prediction
covers every row and whole texts: the distinct (context, byte) pairs of a piece
are looked up once in each language.

Cases: a text that is null or has no letter is `und` with score 0, as is every
text if no language was learned; languages that code a text equally well go to
the first by name; repeated rows count in training as often as they occur; other
columns are ignored. A null doc_id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import buffers, pieces
from .common import fresh, thrifty

SAMPLE_BYTES = 16 << 20  # of training text for each language
PIECE = 1 << 20
RANDOM = 12.0  # bits a byte that no text of a learned language needs; uniformly random bytes take more
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def four_grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """At each byte, itself and the three before it; zeros stand before a row."""
    x = raw.astype(np.uint32)
    key = x.copy()
    for back in (1, 2, 3):
        key[back:] |= x[:-back] << np.uint32(8 * back)
    starts = offsets[:-1]
    for k in (2, 1, 0):
        at = starts + k
        at = at[at < len(key)]
        key[at] &= np.uint32((1 << 8 * (k + 1)) - 1)
    return key


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key, whether it is there)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _level(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of `bits` bits, bits of each; contexts, bits to leave each) from counted four-grams."""
    cut, inverse = np.unique(keys & np.uint32((1 << bits) - 1), return_inverse=True)
    n = np.bincount(inverse, counts, len(cut))
    context, at = np.unique(cut >> np.uint32(8), return_inverse=True)
    total, kinds = np.bincount(at, n), np.bincount(at)
    return cut, -np.log2(n / (total + kinds)[at]).astype(np.float32), context, -np.log2(kinds / (total + kinds)).astype(np.float32)


class Tree:
    """The frozen contexts of one language: sorted keys with their costs, by order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen, cost, _, leave = _level(keys, counts, 8)
        zero = np.full(256, leave[0] + 8, np.float32)
        zero[seen] = cost
        self.one = np.tile(zero, (256, 1))  # [context byte, byte]
        seen, cost, context, leave = _level(keys, counts, 16)
        self.one[context] += leave[:, None]
        self.one = self.one.ravel()
        self.one[seen] = cost
        self.grams2, self.cost2, context, leave = _level(keys, counts, 24)
        self.escape2 = np.zeros(1 << 16, np.float32)
        self.escape2[context] = leave
        self.grams3, self.cost3, self.context3, self.escape3 = _level(keys, counts, 32)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-gram."""
        at, hit = _find(self.grams3, keys)
        out = np.where(hit, self.cost3[at], 0)
        miss = np.flatnonzero(~hit)
        at, hit = _find(self.context3, keys[miss] >> np.uint32(8))
        out[miss] = np.where(hit, self.escape3[at], 0)
        low = keys[miss] & np.uint32(0xFFFFFF)
        at, hit = _find(self.grams2, low)
        out[miss[hit]] += self.cost2[at[hit]]
        miss, low = miss[~hit], low[~hit]
        out[miss] += self.escape2[low >> np.uint32(8)] + self.one[low & np.uint32(0xFFFF)]
        return out


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i, j in pieces(offsets, PIECE):
            base = int(offsets[i])
            for s in range(base, int(offsets[j]), PIECE):  # a long row in several steps
                e = min(s + PIECE, int(offsets[j]))
                lead = min(3, s - base)
                keys = four_grams(raw[s - lead : e], np.clip(offsets[i : j + 1] - s + lead, 0, e - s + lead) if not lead else np.array([0, e - s + lead]))[lead:]
                coded = pa.array(keys).dictionary_encode()
                distinct, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                edges = np.clip(offsets[i:j], s, e) - s
                some = np.flatnonzero(np.diff(np.append(edges, e - s)))  # rows with bytes in this step
                for k, tree in enumerate(self.trees):
                    cost = tree.bits(distinct).astype(np.float64)
                    out[i + some, k] += np.add.reduceat(cost[place], edges[some])
        return out


def freeze(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The costs of all contexts, from (four-grams, counts) by language."""
    langs = sorted(lang for lang, (keys, _) in counts.items() if len(keys))
    return Model(langs, [Tree(*counts[lang]) for lang in langs])


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted four-grams by language of what a task reads."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts):
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)

    for batch in batches:
        lang = batch["lang"].dictionary_encode()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            raw, offsets = buffers(batch["text"].filter(pa.array(np.asarray(lang.indices) == code)))
            for i, j in pieces(offsets, 4 * PIECE):
                keys = four_grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts = held.setdefault(name, [])
                parts.append(np.unique(keys, return_counts=True))
                if len(parts) >= 8:
                    held[name] = [merge(parts)]
    for name, parts in held.items():
        keys, c = merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(c)], names=["lang", "gram", "n"])


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


def training_rows(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text) of the documents that are learned from."""
    rows = docs.filter((remainder() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    share = [(lang, sample_bytes / size) for lang, size in sizes.items() if size > sample_bytes]
    if share:  # a row for each language: as few as the labels have
        bounds = docs.sparkSession.createDataFrame(share, "lang string, share double")
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.join(F.broadcast(bounds), "lang", "left").filter(F.col("share").isNull() | (place < F.col("share")))
    return rows.select("lang", "text")


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from texts and languages of documents that are not held out."""
    counted = training_rows(docs, sample_bytes).mapInArrow(thrifty(count_contexts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toArrow().combine_chunks()
    if not rows.num_rows:
        return Model([], [])
    coded = rows["lang"].combine_chunks().dictionary_encode()
    code, grams, n = coded.indices.to_numpy(), rows["gram"].to_numpy().astype(np.uint32), rows["n"].to_numpy().astype(np.float64)
    return freeze({lang: (grams[code == k], n[code == k]) for k, lang in enumerate(coded.dictionary.to_pylist())})


def predict(column: pa.Array, letters: np.ndarray, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, bits a byte) of each text; letters: whether it has any."""
    raw, offsets = buffers(column)
    if not model.langs:
        zero = np.zeros(len(letters))
        return ["und"] * len(letters), zero, zero
    rate = model.bits(raw, offsets) / np.maximum(np.diff(offsets), 1)[:, None]
    best = rate.argmin(axis=1)
    least = rate[np.arange(len(best)), best]
    score = 1 / np.exp2(np.maximum(least[:, None] - rate, -1000)).sum(axis=1)
    names = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, score, 0.0), least


def has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _flags(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), bool)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rate = predict(batch["text"], _flags(batch["letters"]), shared.value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["held_out"], pa.array(names, pa.string()), pa.array(score), pa.array(rate)], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select("doc_id", (remainder() == 0).alias("held_out"), "text", has_letter().alias("letters")).mapInArrow(thrifty(run), RESULT)


def keep_identified(docs: DataFrame, model: Model | None = None, random: float = RANDOM) -> DataFrame:
    """docs whose language can be told, with `lang` filled in by the prediction where it is null.

    A document goes if its language is `und`, or if even the best language needs
    `random` or more bits a byte, that is, if it is no text of a learned language (bytes drawn at random need about 8,
    and the escapes to get there).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    schema, (letters,) = docs.schema, fresh(docs, "letters")
    text = "string" in schema["lang"].dataType.simpleString() if "lang" in schema.names else False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, rate = predict(batch["text"], _flags(batch[letters]), shared.value)
            columns = {f.name: batch[f.name] for f in schema}
            if text and columns["lang"].null_count:
                columns["lang"] = pa.array([p if t is None else t for t, p in zip(columns["lang"].to_pylist(), names, strict=True)], columns["lang"].type)
            keep = np.array([n != "und" for n in names], bool) & (rate < random)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(keep))

    return docs.withColumn(letters, has_letter()).mapInArrow(thrifty(run), schema)
