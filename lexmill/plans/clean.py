"""The corpus-cleaning plan: extract, language, masks, filters, exact and near duplicates, as one lazy chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pii import mask_pii, masks_made
from ..functions.quality import reject_reason
from ..functions.text import html_to_text, let, script_language
from ..operators.dedup import exact_dedup
from ..operators.minhash import keep_first
from ..session import cut, fresh

STEPS = ("extract", "lang", "pii", "quality", "dedup")
LEAST_CHARS = 100


def extract(pages: DataFrame, stated: bool = False) -> DataFrame:
    """(doc_id, text, source) of pages (page_id, url, html) with more than LEAST_CHARS characters of text; stated as in html_to_text."""
    return long_enough(pages.select(F.col("page_id").alias("doc_id"), html_to_text(F.col("html"), stated).alias("text"), F.col("url").alias("source")))


def long_enough(docs: DataFrame) -> DataFrame:
    return docs.filter(F.length("text") > LEAST_CHARS)


def in_language(docs: DataFrame, lang: str = "en") -> DataFrame:
    return docs.withColumn("language", script_language(F.col("text"))).filter(F.col("language") == lang)


def _judged(docs: DataFrame, pii: bool, quality: bool) -> DataFrame:
    """docs with the mask applied and rejected rows gone, as wanted.

    The mask, its count and the verdict on the masked text come from one expression behind a
    generator: a filter is not moved below it, so the mask is evaluated once a row.
    """
    def facts(t: Column) -> Column:
        masked = mask_pii(t) if pii else t
        return let(masked, lambda m: F.struct(m.alias("text"), (masks_made(t, m) if pii else F.lit(0).cast("long")).alias("pii_count"), (reject_reason(m) if quality else F.lit(None).cast("string")).alias("reason")))

    (name,) = fresh(docs, "judged")
    one = docs.withColumn(name, F.explode(F.array(let(F.col("text"), facts))))
    new = {"text": F.col(f"{name}.text")} | ({"pii_count": F.col(f"{name}.pii_count")} if pii else {})
    return one.filter(F.col(f"{name}.reason").isNull()).withColumns(new).drop(name)


def without_pii(docs: DataFrame) -> DataFrame:
    return _judged(docs, pii=True, quality=False)


def accepted(docs: DataFrame) -> DataFrame:
    return docs.filter(reject_reason(F.col("text")).isNull())


def run(docs: DataFrame, steps: tuple[str, ...] = STEPS, near: bool = False) -> DataFrame:
    """docs after the named steps, in their fixed order; near adds MinHash to the last."""
    if unknown := set(steps) - set(STEPS):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    if "extract" in steps:
        docs = extract(docs) if "html" in docs.columns else long_enough(docs)
    if "lang" in steps:
        docs = in_language(docs)
    if "pii" in steps:
        docs = _judged(docs, pii=True, quality="quality" in steps)
    elif "quality" in steps:
        docs = accepted(docs)
    if "dedup" in steps:
        docs = exact_dedup(docs)
        if near:
            docs = cut(docs)  # read by the signatures and again by the join
            docs = docs.join(keep_first(docs, 128, 9, 13, 3, short=False), "doc_id", "left_semi")
    return docs
