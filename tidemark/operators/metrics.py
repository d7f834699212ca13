"""Queries over a metrics table: id, name, value, timestamp, agent_id, tags (map), optionally date (the partition column).

Ranges include both ends. Where a metrics table has a date column, a range on timestamp also becomes one on date, so that
partitions are pruned. Tag predicates are lookups in the map: no join. The _join forms take the normalised views instead and
use semi-joins, which need no distinct."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import time_bucket

ROW = ("id", "name", "value", "timestamp", "agent_id")


def between(metrics: DataFrame, start: str, end: str) -> Column:
    """A range of time with both ends, and of days where the table has them."""
    kind = metrics.schema["timestamp"].dataType.simpleString()
    out = F.col("timestamp").between(F.lit(start).cast(kind), F.lit(end).cast(kind))
    if "date" in metrics.columns:
        out = F.col("date").between(F.lit(start).cast("timestamp_ntz").cast("date"), F.lit(end).cast("timestamp_ntz").cast("date")) & out
    return out


def _row(metrics: DataFrame) -> DataFrame:
    return metrics.select(*ROW)


def _has_tag(key: str, value: str) -> Column:
    return F.col("tags").getItem(key) == value


def by_agent(metrics: DataFrame, agent_id: str) -> DataFrame:
    return _row(metrics.where(F.col("agent_id") == agent_id))


def by_agent_range(metrics: DataFrame, agent_id: str, start: str, end: str) -> DataFrame:
    return _row(metrics.where((F.col("agent_id") == agent_id) & between(metrics, start, end))).orderBy(F.desc("timestamp"))


def by_name_range(metrics: DataFrame, name: str, start: str, end: str) -> DataFrame:
    return _row(metrics.where((F.col("name") == name) & between(metrics, start, end))).orderBy(F.desc("timestamp"))


def by_agents(metrics: DataFrame, agent_ids: Iterable[str] | DataFrame, start: str, end: str) -> DataFrame:
    """agent_ids: a small collection, or a DataFrame (agent_id) for large ones. None of them: no rows."""
    rows = metrics.where(between(metrics, start, end))
    if isinstance(agent_ids, DataFrame):
        rows = rows.join(agent_ids.select("agent_id"), "agent_id", "left_semi")
    else:
        ids = sorted(set(agent_ids))
        rows = rows.where(F.col("agent_id").isin(ids) if ids else F.lit(False))
    return _row(rows).orderBy(F.desc("timestamp"))


def by_name_and_tags(metrics: DataFrame, name: str, tags: dict[str, str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Samples of a name with all of tags."""
    rule = functools.reduce(operator.and_, (_has_tag(k, v) for k, v in tags.items()), F.col("name") == name)
    if start is not None and end is not None:
        rule = rule & between(metrics, start, end)
    return _row(metrics.where(rule))


def by_name_and_tag(metrics: DataFrame, name: str, key: str, value: str, start: str, end: str) -> DataFrame:
    return by_name_and_tags(metrics, name, {key: value}, start, end).orderBy(F.desc("timestamp"))


def by_tag_key(metrics: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return _row(metrics.where(F.map_contains_key("tags", key) & between(metrics, start, end)))


def _linked(links: DataFrame, dictionary: DataFrame, rule: Column) -> DataFrame:
    """metric_id of links to dictionary rows that fulfil rule."""
    return links.join(dictionary.where(rule).select(F.col("id").alias("tag_dict_id")), "tag_dict_id", "left_semi").select(F.col("metric_id").alias("id"))


def by_name_and_tags_join(metrics: DataFrame, links: DataFrame, dictionary: DataFrame, name: str, tags: dict[str, str], start: str | None = None, end: str | None = None) -> DataFrame:
    rows = metrics.where(F.col("name") == name)
    if start is not None and end is not None:
        rows = rows.where(between(metrics, start, end))
    for k, v in tags.items():
        rows = rows.join(_linked(links, dictionary, (F.col("tag_key") == k) & (F.col("tag_value") == v)), "id", "left_semi")
    return _row(rows)


def by_tag_key_join(metrics: DataFrame, links: DataFrame, dictionary: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return _row(metrics.where(between(metrics, start, end)).join(_linked(links, dictionary, F.col("tag_key") == key), "id", "left_semi"))


def last_of_agent(metrics: DataFrame, agent_id: str) -> DataFrame:
    """The latest sample of an agent, ties by larger id; no row if none."""
    return _row(metrics.where(F.col("agent_id") == agent_id)).orderBy(F.desc("timestamp"), F.desc("id")).limit(1)


def last_of_all_agents(metrics: DataFrame) -> DataFrame:
    """The latest sample of each agent: one aggregate with partial maxima, no sort."""
    last = F.max_by(F.struct(*ROW), F.struct("timestamp", "id"))
    return metrics.groupBy("agent_id").agg(last.alias("m")).select("m.*")


def time_aggregation(metrics: DataFrame, name: str, start: str, end: str, width: str = "1 minute") -> DataFrame:
    """avg, max, min and count of a metric per time bucket, latest first; buckets without samples are absent."""
    rows = metrics.where((F.col("name") == name) & between(metrics, start, end))
    return bucketed(rows, width).orderBy(F.desc("bucket"))


def bucketed(rows: DataFrame, width: str) -> DataFrame:
    v = F.col("value")
    return rows.groupBy(time_bucket(width, F.col("timestamp")).alias("bucket")).agg(F.avg(v).alias("avg_value"), F.max(v).alias("max_value"), F.min(v).alias("min_value"), F.count("*").alias("sample_count"))


def aggregate_by_tag(metrics: DataFrame, name: str, key: str, start: str, end: str) -> DataFrame:
    """avg and count per value of a tag; samples without it don't count."""
    rows = metrics.where((F.col("name") == name) & between(metrics, start, end) & F.map_contains_key("tags", key))
    return rows.groupBy(F.col("tags").getItem(key).alias("tag_value")).agg(F.avg("value").alias("avg_value"), F.count("*").alias("sample_count"))


def agent_window_stats(metrics: DataFrame, agent_id: str, start: str, end: str) -> DataFrame:
    """count, avg, first and last time of an agent's samples; always one row."""
    rows = metrics.where((F.col("agent_id") == agent_id) & between(metrics, start, end))
    return rows.agg(F.count("*").alias("sample_count"), F.avg("value").alias("avg_value"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def tag_value_distribution(metrics: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """How many samples have each value of a tag."""
    rows = metrics.where(between(metrics, start, end) & F.map_contains_key("tags", key))
    return rows.groupBy(F.col("tags").getItem(key).alias("tag_value")).agg(F.count("*").alias("link_count"))


def kept_after(metrics: DataFrame, threshold: str) -> DataFrame:
    """What retention leaves: samples at the threshold or later."""
    return _row(metrics.where(F.col("timestamp") >= F.lit(threshold).cast(metrics.schema["timestamp"].dataType.simpleString())))


def agent_info(metrics: DataFrame, agents: DataFrame) -> DataFrame:
    """Of each sample's agent: whether it exists, its host now, whether it is active. Samples outlive their agents. The agents' side is broadcast by size, as Spark sees it."""
    a = agents.select(F.col("id").alias("agent_id"), F.col("host").alias("current_host"), "enabled")
    joined = metrics.select("id", "agent_id").join(a, "agent_id", "left")
    return joined.select("id", "agent_id", F.col("enabled").isNotNull().alias("agent_exists"), "current_host", F.coalesce("enabled", F.lit(False)).alias("is_active"))
