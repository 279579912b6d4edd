"""Exact document and line deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_dedup(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """The first row (by doc_id, null last) of each distinct text, or of each distinct digest.

    One scan and one shuffle: the row of the least id is an aggregate, partial before
    the shuffle, so a text that a third of all rows share is no hot key. Of equal ids
    the row with the least hash stays; a null text is a text of its own.
    """
    digest = F.md5(F.col("text").cast("binary")) if digest is None else digest
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*docs.columns))
    return docs.groupBy(digest).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")


def line_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def unique_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of lines whose text occurs once in the whole corpus.

    A line that stands once has one place, so the least place of each counted line
    is the result: one aggregation, no join and no window over a hot line.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    seen = lines.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("at"))
    return seen.filter("n = 1").select("at.doc_id", "at.pos", "line")


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every document with its unique lines in order; emptied documents stay, empty."""
    kept = unique_lines(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return docs.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
