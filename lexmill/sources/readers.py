"""Readers: pages, records, one-file documents, delimited documents, tokens, tokenizers, points."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decode_utf8
from ..functions.tokens import END_OF_TEXT
from ..operators.bpe import Tokenizer

RECORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("language", T.StringType()), T.StructField("pii_count", T.LongType()), T.StructField("quality_filtered", T.BooleanType())])
POINTS = "parameters double, compute_budget double, final_loss double"


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, html) of all *.html and *.htm below a folder; malformed bytes are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm}").load(path)
    return files.select(F.col("path").alias("source"), decode_utf8(F.col("content")).alias("html"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): a file is a document; all line ends become \\n."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return raw.select("name", F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def delimited(spark: SparkSession, path: str, token: str = END_OF_TEXT) -> DataFrame:
    """(text) of the documents that a special token separates; files are split at tokens, empties dropped."""
    return spark.read.text(path, lineSep=token).select(F.col("value").alias("text")).filter(F.length("text") > 0)


def chunk_boundaries(path: str, parts: int, token: bytes) -> list[int]:
    """Byte offsets that cut a local file into about `parts` pieces, each moved on to the next token."""
    import mmap
    import os

    size = os.path.getsize(path)
    if not size:
        return [0]
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        cuts = {0, size}
        for k in range(1, parts):
            at = data.find(token, size * k // parts)
            cuts.add(size if at < 0 else at)
    return sorted(cuts)


def tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """A tokenizer that `sinks.tokenizer` has written."""
    return Tokenizer.from_json(spark.read.text(path, wholetext=True).first()[0])


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, tokens) of files of little-endian 16-bit ids (.bin)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    code = F.hex("content")
    at = F.sequence(F.lit(1), F.length("code") - 3, F.lit(4))
    ids = F.transform(at, lambda i: F.conv(F.concat(F.substr(F.col("code"), i + 2, F.lit(2)), F.substr(F.col("code"), i, F.lit(2))), 16, 10).cast("int"))
    return files.select(F.col("path").alias("name"), code.alias("code")).select("name", F.when(F.length("code") >= 4, ids).otherwise(F.array().cast("array<int>")).alias("tokens"))


def npy_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, tokens) of integer arrays in .npy files, widened to long."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)

    def run(batches):
        for batch in batches:
            arrays = [np.load(io.BytesIO(raw), allow_pickle=False).astype(np.int64).ravel() for raw in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(arrays, pa.list_(pa.int64()))], names=["name", "tokens"])

    return files.select("path", "content").mapInArrow(run, "name string, tokens array<long>")


def isoflop_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTS).option("multiLine", True).json(path)
