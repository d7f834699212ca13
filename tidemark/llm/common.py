"""Pieces that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import shared_dir

#: ASCII white space, the only white space that separates words here.
SPACE = r"[\x20\x09-\x0D]+"
#: What goes to a Python worker at once at most: whole texts are wide, and executors hold a batch on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: Row groups of staged tables, which a write task holds in memory.
ROW_GROUP = {"parquet.block.size": str(16 << 20)}


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text alone (null text: empty), so that no other column can clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    bounded(spark)
    df.write.options(**ROW_GROUP | (options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by staged() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tidemark-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffles_released(spark: SparkSession) -> None:
    """Let go of shuffle files that no table needs any more: Spark deletes them when the driver's JVM collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text; none for an empty one."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH where they are larger. It holds from now on, as a plan reads it when it runs."""
    for key, most in BATCH.items():
        if not 0 < int(spark.conf.get(key).rstrip("bB") if spark.conf.get(key, None) else 0) <= most:
            spark.conf.set(key, most)


def released() -> None:
    """Give memory that a task has freed back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """df through fn, batch by batch."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            released()

    return df.mapInArrow(run, schema)
