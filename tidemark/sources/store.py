"""Stores: date-partitioned parquet (default) and JDBC; and the normalised views of a metrics table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.tags import tag_hash
from tidemark.schema import METRICS
from tidemark.session import shared_dir


def write_metrics(metrics: DataFrame, path: str, round_id: str | None = None) -> None:
    """Add samples, a folder per day and round; within a file by name and time, so that row groups can be skipped. A large day is split over as many tasks as its
    size asks for. Rows of a round_id replace what was stored of that round on the same days, so a round can be written again; without one they are a round of their own."""
    rows = metrics if "scraped_at" in metrics.columns else metrics.withColumn("scraped_at", F.lit(None).cast("timestamp"))
    rows = rows.withColumn("date", F.to_date("timestamp")).withColumn("round", F.lit(round_id or f"own-{uuid.uuid4().hex}"))
    replaced(rows.hint("rebalance", F.col("date")).sortWithinPartitions("date", "name", "timestamp"), path)


def replaced(rows: DataFrame, path: str, *by: str) -> None:
    """Rows into folders by date and round (or by others), each of which they replace whole. Jobs that write to one table at a time don't disturb each other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(by or ("date", "round"))).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    df.write.option("batchsize", 100).jdbc(url, table, mode="append", properties=properties or {})


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 1), partitions: int = 20, properties: dict[str, str] | None = None) -> DataFrame:
    if column:
        return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


def metric_tag_pairs(metrics: DataFrame) -> DataFrame:
    """metric_id, tag_key, tag_value: the tag map, exploded."""
    return metrics.select(F.col("id").alias("metric_id"), F.explode("tags").alias("tag_key", "tag_value"))


def numbered(pairs: DataFrame, after: int = 0) -> DataFrame:
    """Distinct pairs as dictionary rows, with ids that follow `after` in order of key and value. Sorted by ranges, so that neither a key nor the dictionary
    lies in one task; only the ranges' counts meet in one place. The sorted pairs are written to the shared folder, as ranges may be drawn otherwise if they are sorted again."""
    spark = pairs.sparkSession
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    pairs.orderBy("tag_key", "tag_value").select("tag_key", "tag_value", F.monotonically_increasing_id().alias("at")).write.parquet(path)
    # the upper bits of at are the range, the lower 33 the place in it
    rows = spark.read.schema("tag_key string, tag_value string, at long").parquet(path).withColumn("slice", F.shiftright("at", 33))
    counts = rows.groupBy(F.col("slice").alias("of")).agg(F.count("*").alias("n"))
    firsts = counts.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ident = F.lit(after + 1) + F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(firsts, F.col("slice") == F.col("of")).select(ident.cast("long").alias("id"), "tag_key", "tag_value", tag_hash(F.col("tag_key"), F.col("tag_value")).alias("hash"))


def tags_dict(metrics: DataFrame) -> DataFrame:
    """Distinct pairs with a number in order of key and value, and the hash."""
    return numbered(metric_tag_pairs(metrics).select("tag_key", "tag_value").distinct())


def metric_tags(metrics: DataFrame, dictionary: DataFrame) -> DataFrame:
    """metric_id, tag_dict_id."""
    return metric_tag_pairs(metrics).join(dictionary, ["tag_key", "tag_value"]).select("metric_id", F.col("id").alias("tag_dict_id"))
