"""What the operators of this subpackage share: table access, shared-folder checkpoints."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, fresh  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text="text"):
    """128-bit identity of a text as binary; null stays null."""
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))


def packed(done: DataFrame) -> DataFrame:
    """What cut gave, read in parts of about the advisory size: the driver need not follow a task for each small part that wrote it."""
    spark = done.sparkSession
    rows = done._jdf.queryExecution().logical().rdd()
    folder = spark._jvm.org.apache.hadoop.fs.Path(rows.getCheckpointFile().get())
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    part = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    wanted = max(-(-size // part), spark.sparkContext.defaultParallelism)
    return done.coalesce(wanted) if wanted < rows.getNumPartitions() else done


def release_memory() -> None:
    """Give freed memory back to the system: Python workers are reused from stage to stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which a worker keeps no freed memory."""

    def thrifty_run(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return thrifty_run


def keep_rows(df: DataFrame, mask) -> DataFrame:
    """The rows of df for which mask(batch) -> array of booleans holds; all columns as they were."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(mask(batch), pa.bool_()))

    return df.mapInArrow(thrifty(run), df.schema)
