"""Series store: samples as points of a series, a table of series, and an index from tag pairs to series.

A series is a name, an agent and tags; its id is a hash of these, and its bucket a part of the id. Points (series_id, id, timestamp, value) lie in folders by
bucket and day, sorted by series, so a tag is read once for each series and not for each sample. Tag questions are answered on the index, which is sorted by
pair: what they leave are series with their buckets, and a join with the points reads the buckets of these series alone (dynamic partition pruning), as far as the range's days go.

The series that a question leaves are broadcast only if they are counted and few; else the join is a shuffle, and nearly all buckets are read anyway."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import retention
from tidemark.operators.metrics import ROW, between
from tidemark.sources.files import Files
from tidemark.sources.store import replaced

#: Buckets of a new store, and series (about 100 bytes each) that may be broadcast.
BUCKETS, BROADCAST_SERIES = 64, 200_000
_TABLES = {
    "points": "series_id long, id long, timestamp timestamp, value double, bucket int, date date, round string",
    "series": "series_id long, bucket int, name string, agent_id string, tags map<string,string>, round string",
    "pairs": "series_id long, bucket int, name string, agent_id string, tag_key string, tag_value string, round string",
}


def series_of(metrics: DataFrame, buckets: int) -> DataFrame:
    """metrics with series_id and bucket. Tags are hashed in order of key, so that their order in the map doesn't matter."""
    ident = F.xxhash64("name", "agent_id", F.array_sort(F.map_entries("tags")).cast("string"))
    return metrics.withColumn("series_id", ident).withColumn("bucket", F.pmod(F.col("series_id"), F.lit(buckets)).cast("int"))


class SeriesStore:
    """The three tables below one path: points, series, pairs."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets, self.files = spark, path, buckets, Files(spark, path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}") if self.files.exists(f"{self.path}/{name}") else self.spark.createDataFrame([], _TABLES[name])

    def points(self) -> DataFrame:
        return self._read("points")

    def series(self) -> DataFrame:
        return self._read("series")

    def pairs(self) -> DataFrame:
        return self._read("pairs")

    def add(self, metrics: DataFrame, round_id: str | None = None) -> None:
        """Samples, and the series and pairs that are new with them, in folders of their round, which replace what was stored of it: a round that broke off can be added again. Known
        series aren't written again. A hash that stands for two series is an error, before anything is written. One writer at a time, or two may both write a new series."""
        name = round_id or f"own-{uuid.uuid4().hex}"
        rows = series_of(metrics, self.buckets)
        kind = {c: F.any_value(c).alias(c) for c in ("bucket", "name", "agent_id", "tags")}
        text = F.concat_ws("\x00", "name", "agent_id", F.array_sort(F.map_entries("tags")).cast("string"))
        found = rows.groupBy("series_id").agg(*kind.values(), F.min(text).alias("low"), F.max(text).alias("high"))
        if self.files.exists(f"{self.path}/series"):
            found = found.join(self.series().select("series_id", text.alias("known")), "series_id", "left")
        else:
            found = found.withColumn("known", F.lit(None).cast("string"))
        found = found.persist()
        try:
            clash = found.where("low <> high or low <> known").limit(1).collect()
            if clash:
                raise ValueError(f"two series have one hash: {clash[0]['series_id']}")
            new = found.where("known is null").select("series_id", *kind, F.lit(name).alias("round"))
            pairs = new.select("series_id", "bucket", "name", "agent_id", F.explode("tags").alias("tag_key", "tag_value"), "round")
            # a range of pairs in each file, so that a question reads few of them
            replaced(pairs.repartitionByRange("tag_key", "tag_value", "series_id").sortWithinPartitions("tag_key", "tag_value"), f"{self.path}/pairs", "round")
            replaced(new.sortWithinPartitions("name", "series_id"), f"{self.path}/series", "round")
        finally:
            found.unpersist()
        points = rows.select("series_id", "id", "timestamp", "value", "bucket", F.to_date("timestamp").alias("date"), F.lit(name).alias("round"))
        replaced(points.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "date", "series_id", "timestamp"), f"{self.path}/points", "bucket", "date", "round")

    def delete_before(self, threshold: datetime.datetime) -> None:
        """Points before a threshold go, bucket by bucket as retention does it; series stay known."""
        schema = ", ".join(c for c in _TABLES["points"].split(", ") if c != "bucket int")
        for name in self.files.names(f"{self.path}/points"):
            if name.startswith("bucket="):
                retention.delete_before(self.spark, f"{self.path}/points/{name}", threshold, schema, ("series_id", "timestamp"))

    # Questions

    def _pair(self, key: str, value: str | None = None) -> Column:
        rule = F.col("tag_key") == key
        return rule if value is None else rule & (F.col("tag_value") == value)

    def matching(self, name: str | None, tags: dict[str, str]) -> DataFrame:
        """Series of a name with all of tags (at least one): series_id, bucket, name, agent_id."""
        (key, value), *rest = tags.items()
        rows = self.pairs().where(self._pair(key, value))
        rows = rows if name is None else rows.where(F.col("name") == name)
        for k, v in rest:
            rows = rows.join(self.pairs().where(self._pair(k, v)).select("series_id"), "series_id", "left_semi")
        return rows.select("series_id", "bucket", "name", "agent_id")

    def with_key(self, key: str, name: str | None = None) -> DataFrame:
        """Series that have a tag: the columns of matching() and tag_value."""
        rows = self.pairs().where(self._pair(key))
        rows = rows if name is None else rows.where(F.col("name") == name)
        return rows.select("series_id", "bucket", "name", "agent_id", "tag_value")

    def samples(self, series: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
        """Points of series with the series' columns. The buckets of other series aren't read."""
        points = self.points()
        if start is not None and end is not None:
            points = points.where(between(points, start, end))
        side = F.broadcast(series) if series.count() <= BROADCAST_SERIES else series
        return points.join(side, ["bucket", "series_id"])

    def by_name_and_tags(self, name: str, tags: dict[str, str], start: str | None = None, end: str | None = None) -> DataFrame:
        return self.samples(self.matching(name, tags), start, end).select(*ROW)

    def by_tag_key(self, key: str, start: str, end: str) -> DataFrame:
        return self.samples(self.with_key(key), start, end).select(*ROW)

    def aggregate_by_tag(self, name: str, key: str, start: str, end: str) -> DataFrame:
        rows = self.samples(self.with_key(key, name), start, end)
        return rows.groupBy("tag_value").agg(F.avg("value").alias("avg_value"), F.count("*").alias("sample_count"))

    def tag_value_distribution(self, key: str, start: str, end: str) -> DataFrame:
        """Counted by series first, so that the join has a row for each series and not for each sample."""
        points = self.points()
        counts = points.where(between(points, start, end)).groupBy("bucket", "series_id").agg(F.count("*").alias("n"))
        return counts.join(self.with_key(key), ["bucket", "series_id"]).groupBy("tag_value").agg(F.sum("n").alias("link_count"))

    def metrics(self) -> DataFrame:
        """The samples as a metrics table."""
        return self.points().join(self.series(), ["bucket", "series_id"]).select(*ROW, "tags")

