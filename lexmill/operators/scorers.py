"""Pluggable models over texts, and samples of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh

Scorer = Callable[[list[str]], list[tuple[str, float]]]


def scored(docs: DataFrame, load: Callable[[], Scorer], label: str = "label", score: str = "score", prefix: str = "") -> DataFrame:
    """docs with the label and score that a model gives each text; null for a null text.

    `load` returns the model and runs once in a task; the model gets the texts of a batch at a
    time, with line ends as spaces, and returns as many (label, score) pairs. A prefix of
    labels (as __label__) is cut off.
    """
    (given,) = fresh(docs, "given")
    schema = docs.select("*", F.lit("").alias(label), F.lit(0.0).alias(score)).schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            texts = batch[given].to_pylist()
            known = iter(model([t for t in texts if t is not None]))
            pairs = [(None, None) if t is None else next(known) for t in texts]
            labels = [None if x is None else x.removeprefix(prefix) for x, _ in pairs]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(labels, pa.string()), pa.array([s for _, s in pairs], pa.float64())], names=[*names, label, score])

    schema[label].nullable = schema[score].nullable = True
    return docs.withColumn(given, F.translate("text", "\r\n", "  ")).mapInArrow(run, schema)


def identify_language(docs: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """docs with language and language_score by a model that names languages as __label__xx."""
    return scored(docs, load, "language", "language_score", "__label__")


def sample_documents(docs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n documents drawn at random, the same ones for a seed; a top-n by a hash, so only n rows meet."""
    return docs.orderBy(F.xxhash64(F.lit(seed), "doc_id", "text"), "doc_id").limit(n)
