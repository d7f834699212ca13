"""A tag dictionary that grows: pairs keep their ids, and a batch of new pairs reads and adds to the buckets of these pairs alone.

A pair's bucket is a part of its hash, and bucket b of n numbers its pairs b + 1, b + 1 + n, b + 1 + 2n .. in the order in which they come; so no two buckets meet to number
theirs. What a batch adds is written aside and becomes part of the dictionary with a commit, a file that only one of several writers can create; the others look again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.tags import tag_hash
from tidemark.sources.files import Files

BUCKETS, TRIES = 64, 100
_SCHEMA = "id long, tag_key string, tag_value string, hash string, bucket int"


class Dictionary:
    """id, tag_key, tag_value, hash, bucket. A dictionary's number of buckets is fixed by its first commit."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.files = spark, path, Files(spark, path)
        commits = self._commits()
        self.buckets = json.loads(self.files.read(f"{path}/{commits[0]}"))["buckets"] if commits else buckets

    def _commits(self) -> list[str]:
        return [n for n in self.files.names(self.path) if n.endswith(".json") and not n.startswith("_")]

    def _read(self, commits: list[str]) -> DataFrame:
        parts = [json.loads(self.files.read(f"{self.path}/{c}"))["data"] for c in commits]
        return self._folders(*parts) if parts else self.spark.createDataFrame([], _SCHEMA)

    def _folders(self, *parts: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(*(f"{self.path}/{p}" for p in parts)).select("id", "tag_key", "tag_value", "hash", "bucket")

    def rows(self) -> DataFrame:
        return self._read(self._commits())

    def _bucketed(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("tag_key", "tag_value", F.pmod(F.xxhash64("tag_key", "tag_value"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct()

    def add(self, pairs: DataFrame) -> int:
        """The pairs (tag_key, tag_value) that the dictionary lacks get ids, in order of key and value within their buckets. Returns how many these were."""
        wanted = self._bucketed(pairs).persist()
        try:
            touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # no more than there are buckets
            for _ in range(TRIES):
                commits = self._commits()
                known = self._read(commits).where(F.col("bucket").isin(touched))
                new = wanted.join(known, [wanted.bucket == known.bucket, wanted.tag_key.eqNullSafe(known.tag_key), wanted.tag_value.eqNullSafe(known.tag_value)], "left_anti")
                held = known.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("held"))
                place = F.row_number().over(Window.partitionBy("bucket").orderBy("tag_key", "tag_value")) - 1
                ident = F.col("bucket") + 1 + F.lit(self.buckets).cast("long") * (F.coalesce("held", F.lit(0)) + F.col("place"))
                rows = new.withColumn("place", place).join(held, F.col("bucket") == F.col("of"), "left")
                rows = rows.select(ident.alias("id"), "tag_key", "tag_value", tag_hash(F.col("tag_key"), F.col("tag_value")).alias("hash"), "bucket")
                data = f"commit={uuid.uuid4().hex}"
                rows.sortWithinPartitions("bucket", "tag_key", "tag_value").write.partitionBy("bucket").parquet(f"{self.path}/{data}")
                added = self._folders(data).count()
                number = int(commits[-1].partition(".")[0]) + 1 if commits else 1
                if added and self.files.create(f"{self.path}/{number:020d}.json", json.dumps({"data": data, "buckets": self.buckets})):
                    return added
                self.files.delete(f"{self.path}/{data}")
                if not added:
                    return 0
            raise RuntimeError(f"others were faster: {self.path}")
        finally:
            wanted.unpersist()
