"""Toxicity by a classifier chain.

The categories of the label table are predicted in a fixed order, each by a
logistic regression on word and word-pair features (present or not) and on the
probabilities of all categories before it. While training, those probabilities
are out-of-fold predictions, so a later link sees its predecessors as good as
they will be on new text. Features are 64-bit hashes of words and pairs, looked up
exactly. Each link is fitted on the features that `least_rows` sample rows have and
whose presence differs between its classes by more than `least_z` standard errors;
its threshold is the one with the best out-of-fold F1.

The training sample is bounded: `max_rows` labelled documents, those first by a
hash of the id. Words, their counts and predictions cover whole texts.

Cases: a null or empty text has no features; a category without both classes
among the labels is predicted as its share; without labels, 0 everywhere; labels
that contradict each other for a document count as 1; documents are predicted
row by row, so repeated rows agree; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE_B, MIX_1, U64, buffers, mix, pieces, span_hashes, words
from .common import thrifty

MAX_ROWS, FOLDS = 8000, 5
LEAST_ROWS, LEAST_Z = 4, 4.0
PIECE = 1 << 20
#: Chain order: (name, SQL over the label table). Junk comes first: its probability helps to read the rest.
CHAIN = [("low_quality", "1 - quality"), ("toxic", "toxic")]


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Per row the distinct hashed words and pairs of neighbouring words."""
    raw, offsets = buffers(column)
    for i, j in pieces(offsets, PIECE):
        low, starts, ends, first = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h = span_hashes(low, starts, ends)
        with np.errstate(over="ignore"):
            pairs = mix(h[:-1] * MIX_1 + h[1:] * BASE_B) if len(h) > 1 else h[:0]
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(np.concatenate((h[a:b], pairs[a : max(a, b - 1)])))


@dataclass
class Sparse:
    """Rows with a 1 in some columns, and dense columns beside them."""

    row: np.ndarray
    column: np.ndarray
    n: int
    p: int
    extra: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) + self.extra @ w[self.p :]

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.column, g[self.row], self.p), self.extra.T @ g))


def fit(x: Sparse, y: np.ndarray, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; (weights, bias)."""
    n = x.n
    w, b = np.zeros(x.p + x.extra.shape[1]), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    widest = (np.bincount(x.row, minlength=n) + np.square(x.extra).sum(axis=1)).max(initial=1.0)
    v, vb, step, t = w.copy(), b, 1 / (0.0625 * (widest + 1) + l2 / n), 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x.times(v) + vb, -30, 30))) - y
        w_new, b_new = v - step * (x.transposed_times(g) / n + l2 / n * v), vb - step * float(g.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, b


@dataclass
class Link:
    name: str
    columns: np.ndarray  # features in use, ascending
    weights: np.ndarray  # of them, then of the links before
    bias: float
    threshold: float = 0.5


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.links)))
        size = np.array([len(r) for r in rows], np.int64)
        flat, row = np.concatenate([*rows, np.zeros(0, U64)]), np.repeat(np.arange(len(rows)), size)
        for k, link in enumerate(self.links):
            n = len(link.columns)
            at = np.minimum(np.searchsorted(link.columns, flat), max(n - 1, 0))
            hit = np.flatnonzero(link.columns[at] == flat) if n else np.zeros(0, np.int64)
            z = np.bincount(row[hit], link.weights[at[hit]], len(rows)) + link.bias + out[:, :k] @ link.weights[n:]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def choose(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """The numbers below width, of features whose presence differs between the classes."""
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n1, n0 = y.sum(), len(y) - y.sum()
    a, total = np.bincount(flat, y[row], width), np.bincount(flat, minlength=width)
    p = total / len(y)
    z = np.abs(a / n1 - (total - a) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    return np.flatnonzero((total >= LEAST_ROWS) & (z > LEAST_Z))


def matrix(rows: list[np.ndarray], columns: np.ndarray, extra: np.ndarray, width: int) -> Sparse:
    place = np.full(width, -1, np.int64)
    place[columns] = np.arange(len(columns))
    at = place[np.concatenate(rows)]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return Sparse(row[at >= 0], at[at >= 0], len(rows), len(columns), extra.astype(np.float64))


def train_chain(rows: list[np.ndarray], labels: np.ndarray, names: list[str]) -> Chain:
    chain, earlier = Chain(), np.zeros((len(rows), 0))
    names_of, number = np.unique(np.concatenate([*rows, np.zeros(0, U64)]), return_inverse=True)
    rows, width = np.split(number, np.cumsum([len(r) for r in rows])[:-1]) if rows else [], len(names_of)
    fold = np.arange(len(rows)) % FOLDS
    for k, name in enumerate(names):
        y = labels[:, k].astype(np.float64)
        if len(rows) < 2 * FOLDS or y.sum() < FOLDS or (1 - y).sum() < FOLDS:
            share = float(y.mean()) if len(y) else 0.0
            bias = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30))
            chain.links.append(Link(name, np.zeros(0, U64), np.zeros(k), bias))
            earlier = np.concatenate((earlier, np.full((len(rows), 1), share)), axis=1)
            continue
        guess = np.zeros(len(rows))
        for f in range(FOLDS):
            learn, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            columns = choose([rows[i] for i in learn], y[learn], width)
            w, b = fit(matrix([rows[i] for i in learn], columns, earlier[learn], width), y[learn])
            z = matrix([rows[i] for i in test], columns, earlier[test], width).times(w) + b
            guess[test] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        columns = choose(rows, y, width)
        w, b = fit(matrix(rows, columns, earlier, width), y)
        order = np.argsort(-guess)
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        at = int(f1.argmax())
        below = guess[order[at + 1]] if at + 1 < len(y) else 0.0
        chain.links.append(Link(name, names_of[columns], w, float(b), float((guess[order[at]] + below) / 2)))
        earlier = np.concatenate((earlier, guess[:, None]), axis=1)
    return chain


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, chain: list[tuple[str, str]] = CHAIN) -> Chain:
    names = [n for n, _ in chain]
    known = labels.filter(F.col("doc_id").isNotNull()).selectExpr("cast(doc_id as long) doc_id", *(f"cast({sql} as int) {n}" for n, sql in chain)).dropna()
    sample = known.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r.tobytes() for r in features(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(batch[n] for n in names), pa.array(found, pa.binary())], names=["doc_id", *names, "found"])

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(sample), "doc_id")  # at most max_rows rows of a few integers
        .mapInArrow(run, f"doc_id long, {', '.join(f'{n} int' for n in names)}, found binary")
        .toArrow()
        .sort_by("doc_id")
    )
    # dealt to folds by id hash, so that neighbours do not share one
    order = np.argsort(mix(rows["doc_id"].to_numpy().astype(np.int64).view(U64)), kind="stable")
    found = rows["found"].to_pylist()
    values = np.stack([rows[n].to_numpy() for n in names], axis=1) if len(order) else np.zeros((0, len(names)))
    return train_chain([np.frombuffer(found[i], U64) for i in order], values[order], names)


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, p_<category> and <category> of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [link.name for link in model.links]
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", " + ", ".join(f"{n} boolean" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            p = chain.predict(list(features(batch["text"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(p[:, k].copy()) for k in range(len(names))), *(pa.array(p[:, k] >= link.threshold) for k, link in enumerate(chain.links))], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), schema)
