"""Retention and compaction of a store of samples (folders date=../round=..): single files are replaced, and what arrives meanwhile stays.

A replacement is prepared in a hidden folder and becomes due with its plan, which names the old files and the place of the new ones. A call after one
that broke off finishes replacements that have a plan and forgets the others. One maintenance job at a time; any number of writers and readers beside it. Rewritten
rows leave their round, so the day should be one whose rounds aren't replayed any more. A reader may miss the rows of a replacement for the moment between the last deletion and the renaming."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.schema import METRICS
from tidemark.sources.files import Files


def utc_text(at: datetime.datetime) -> str:
    """A time as text in UTC, which sessions here cast text in. One without a zone is local time, as createDataFrame takes it."""
    return at.astimezone(datetime.UTC).replace(tzinfo=None).isoformat(sep=" ")


def recovered(spark: SparkSession, path: str) -> None:
    """Finish or forget replacements that broke off."""
    files = Files(spark, path)
    for name in files.names(path):
        if name.startswith("_replace_"):
            if files.exists(f"{path}/{name}/plan.json"):
                _finished(files, path, name)
            else:
                files.delete(f"{path}/{name}")


def _finished(files: Files, path: str, name: str) -> None:
    plan = json.loads(files.read(f"{path}/{name}/plan.json"))
    for old in plan["old"]:
        files.delete_uri(old)
    if files.exists(f"{path}/{name}/data"):
        files.rename(f"{path}/{name}/data", f"{path}/{plan['place']}")
    files.delete(f"{path}/{name}")


def _day(spark: SparkSession, path: str, day: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/date={day}")


def _replaced(spark: SparkSession, path: str, day: str, old: list[str], keep: Column | None, kind: str, schema: StructType | str, order: tuple[str, ...]) -> None:
    """Files of a day replaced by the rows of them that keep leaves, in a round of their own."""
    files, name = Files(spark, path), f"_replace_{uuid.uuid4().hex}"
    rows = spark.read.schema(schema).option("basePath", path).parquet(*old)
    rows = rows if keep is None else rows.where(keep)
    rows.drop("date", "round").hint("rebalance").sortWithinPartitions(*order).write.parquet(f"{path}/{name}/data")
    files.write(f"{path}/{name}/plan.json", json.dumps({"old": old, "place": f"date={day}/round={kind}-{uuid.uuid4().hex}"}))
    _finished(files, path, name)


def _days(files: Files, path: str) -> list[str]:
    return [n.removeprefix("date=") for n in files.names(path) if n.startswith("date=")]


def delete_before(spark: SparkSession, path: str, threshold: datetime.datetime, schema: StructType | str = METRICS, order: tuple[str, ...] = ("name", "timestamp")) -> list[str]:
    """Drop samples before a threshold: the folders of earlier days go, and of the threshold's day those files alone are rewritten that hold an earlier
    sample. Returns the dropped days. No row before that day is read."""
    recovered(spark, path)
    files, at = Files(spark, path), utc_text(threshold)
    days, cut = _days(files, path), at[:10]
    gone = [d for d in days if d < cut]
    for d in gone:
        files.delete(f"{path}/date={d}")
    if cut in days:
        limit = F.lit(at).cast("timestamp")
        old = [r["f"] for r in _day(spark, path, cut, schema).where(F.col("timestamp") < limit).select(F.col("_metadata.file_path").alias("f")).distinct().collect()]  # of one day
        if old:
            _replaced(spark, path, cut, old, F.col("timestamp") >= limit, "kept", schema, order)
    return gone


def compact_day(spark: SparkSession, path: str, day: str) -> int:
    """The files of a day as few sorted ones, for rounds make at least one file each. Returns how many were replaced."""
    recovered(spark, path)
    old = [r["f"] for r in _day(spark, path, day, METRICS).select(F.col("_metadata.file_path").alias("f")).distinct().collect()]
    if len(old) > 1:
        _replaced(spark, path, day, old, None, "compact", METRICS, ("name", "timestamp"))
    return len(old)
