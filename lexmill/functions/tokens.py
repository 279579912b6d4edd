"""Pre-tokens, bytes and pair counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published GPT-2 pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def split_special(text: Column, special: str = END_OF_TEXT, empty: bool = False) -> Column:
    """The parts between special tokens, which are dropped; empty parts only if wanted."""
    parts = F.split(text, rf"\Q{special}\E", -1)
    return parts if empty else F.filter(parts, lambda p: p != "")


def pretoken_counts(docs: DataFrame) -> DataFrame:
    """(tok, n): partial counts are summed on each side of one shuffle."""
    parts = docs.select(F.explode(split_special(F.col("text"))).alias("part"))
    return parts.select(F.explode(pretokens(F.col("part"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


def byte_pair_counts(counts: DataFrame) -> DataFrame:
    """(pair as hex, n): neighbouring bytes of counted pre-tokens."""
    code = F.hex(F.encode("tok", "UTF-8"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("code") - 3, F.lit(2)), lambda i: F.substr(F.col("code"), i, F.lit(4)))
    spread = counts.select("n", code.alias("code")).filter(F.length("code") >= 4).select("n", F.explode(pairs).alias("pair"))
    return spread.groupBy("pair").agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of several, the greatest by bytes."""
    return pairs.agg(F.max(F.struct("n", "pair")).alias("best")).select("best.pair", "best.n")
