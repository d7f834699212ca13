"""The engine's tables from the driver's: metrics from events, agents from customers, runs from events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir
from tidemark.sources import store
from tidemark.sources.files import Files
from tidemark.sources.series import SeriesStore


def metrics_of(events: DataFrame) -> DataFrame:
    agent = F.col("user_id").cast("string")
    tags = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("agent_id"), agent)
    return events.select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), "value", F.col("ts").alias("timestamp"), agent.alias("agent_id"), tags.alias("tags"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


#: Views stored by this process: of application, name and the source's state, the path.
_STORED: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, made: Callable[[str], object]) -> str:
    """The path of a view of events, written to the shared folder when first asked for, as an engine that keeps dictionary and links as tables has them. It holds as long
    as the source's files are the same: names, sizes and times are looked at each time."""
    key = (spark.sparkContext.applicationId, name, Files(spark, sf_dir).state(f"{sf_dir}/events.parquet"))
    if key not in _STORED:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        made(path)
        _STORED[key] = path
    return _STORED[key]


def tags_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_stored(spark, sf_dir, "tags_dict", lambda path: store.tags_dict(metrics(spark, sf_dir)).write.parquet(path)))


def metric_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, in order of their entry, so that those of one lie in few row groups."""
    return spark.read.parquet(_stored(spark, sf_dir, "metric_tags", lambda path: store.metric_tags(metrics(spark, sf_dir), tags_dict(spark, sf_dir)).orderBy("tag_dict_id", "metric_id").write.parquet(path)))


def series(spark: SparkSession, sf_dir: str) -> SeriesStore:
    """The series store of events."""
    return SeriesStore(spark, _stored(spark, sf_dir, "series", lambda path: SeriesStore(spark, path, 16).add(metrics(spark, sf_dir))), 16)


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_scrape_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") % 10 != 7).join(last, "c_custkey", "left")
    key = F.col("c_custkey")
    made = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        key.cast("string").alias("id"), F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string")).alias("host"), (9090 + key % 10).cast("int").alias("port"), F.lit("/metrics").alias("path"),
        (15 * (key % 3)).cast("long").alias("scrape_interval_seconds"), (F.col("c_acctbal") >= 0).alias("enabled"), F.lit(5).alias("timeout_seconds"), "last_scrape_at",
        F.when(F.col("kind") == "error", "failed: error").when(F.col("kind") == "signup", "empty").when(F.col("kind").isNotNull(), "success").alias("last_scrape_status"), made.alias("created_at"), made.alias("updated_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    n = F.when(failed, 0).otherwise(1).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("agent_id"), F.col("ts").alias("started_at"), F.timestamp_add("MILLISECOND", F.col("value").cast("int"), F.col("ts")).alias("finished_at"), n.alias("n_samples"),
        F.when(failed, "failed: error").otherwise("success").alias("status"), F.when(failed, "error").alias("error"),
    )
