"""Queries over the tag dictionary: id, tag_key, tag_value, hash; and over links: metric_id, tag_dict_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import numbered


def by_pair(dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """The entry of a pair; no row if none. Pairs are unique, hashes need not be."""
    return dictionary.where((F.col("tag_key") == key) & (F.col("tag_value") == value)).limit(1)


def pair_frame(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "tag_key string, tag_value string")


def by_pairs(dictionary: DataFrame, pairs: DataFrame) -> DataFrame:
    return dictionary.join(pairs.select("tag_key", "tag_value"), ["tag_key", "tag_value"], "left_semi").select("id", "tag_key", "tag_value", "hash")


def by_key(dictionary: DataFrame, key: str) -> DataFrame:
    return dictionary.where(F.col("tag_key") == key)


def completions(dictionary: DataFrame, key: str, pattern: str) -> DataFrame:
    """Entries of a key whose value has pattern in it; % and _ in it are wildcards."""
    return dictionary.where((F.col("tag_key") == key) & F.col("tag_value").like(f"%{pattern}%"))


def keys(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("tag_key").distinct().orderBy("tag_key")


def values(dictionary: DataFrame, key: str) -> DataFrame:
    return dictionary.where(F.col("tag_key") == key).select("tag_value").orderBy("tag_value")


def links_of(links: DataFrame, metric_id: int) -> DataFrame:
    return links.where(F.col("metric_id") == metric_id)


def without_links_of(links: DataFrame, metric_id: int) -> DataFrame:
    """Links after those of a metric are deleted."""
    return links.where(~F.col("metric_id").eqNullSafe(metric_id))


def missing_pairs(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs that the dictionary lacks."""
    return pairs.select("tag_key", "tag_value").distinct().join(dictionary, ["tag_key", "tag_value"], "left_anti")


def attached(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Links of (metric_id, tag_key, tag_value); pairs that the dictionary lacks give none."""
    return pairs.join(dictionary.select(F.col("id").alias("tag_dict_id"), "tag_key", "tag_value"), ["tag_key", "tag_value"]).select("metric_id", "tag_dict_id")


def extended(dictionary: DataFrame, pairs: DataFrame) -> DataFrame:
    """The dictionary with the pairs it lacked; new ids follow the largest, in order of key and value."""
    last = dictionary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    return dictionary.select("id", "tag_key", "tag_value", "hash").unionByName(numbered(missing_pairs(pairs, dictionary), last))
