"""Writers for records, documents, tokens, tokenizers and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bpe import Tokenizer

UINT16 = 65535


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def documents(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """Parquet; by default what is there already stays."""
    df.write.mode(mode).parquet(path)


def tokens(encoded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(doc_id, ids) as Parquet; an id that 16 bits cannot hold stops the job."""
    checked = F.transform("ids", lambda i: F.when((i >= 0) & (i <= UINT16), i).otherwise(F.raise_error(F.concat(F.lit("token id out of 16 bits: "), i.cast("string"))).cast("int")))
    encoded.select("doc_id", checked.alias("ids")).write.mode(mode).parquet(path)


def tokenizer(spark: SparkSession, tokenizer: Tokenizer, path: str, mode: str = "errorifexists") -> None:
    spark.createDataFrame([(tokenizer.to_json(),)], "value string").coalesce(1).write.mode(mode).text(path)


def result(spark: SparkSession, values: dict, path: str, mode: str = "errorifexists") -> None:
    import json

    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode(mode).text(path)
