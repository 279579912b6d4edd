"""Streaming twins of the stateless stages and of exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.pii import mask_pii, pii_counts
from ..functions.quality import reject_reason
from ..functions.text import script_language
from ..operators.bpe import Tokenizer, encode


def stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", name: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Files that arrive in a folder; name: only the table of that name in it, be it a file or a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind)
    return reader.load(f"{path}/{name[:-1]}[{name[-1]}]" if name else path)


def masked(docs: DataFrame) -> DataFrame:
    """Language, masked text and number of masks; works on batches and streams alike."""
    return docs.withColumns({"language": script_language(F.col("text")), "pii_count": pii_counts(F.col("text")), "text": mask_pii(F.col("text"))})


def accepted(docs: DataFrame) -> DataFrame:
    return docs.filter(reject_reason(F.col("text")).isNull())


def encoded(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    return encode(docs, tokenizer)


def deduplicated(docs: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first document of each text within the delay; state older than that is dropped.

    `time` may be a timestamp without zone; it is read in the session's zone.
    """
    keyed = docs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return keyed.withColumn("__h", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width, slide or width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there to Parquet and stops."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
