"""Buckets of any width over a stream with a watermark: months and years too, each appended once, when it is closed.

Windows of a fixed length can't be months. Samples are therefore reduced to days (or to the hours, minutes.. that a width is made of) by a windowed aggregate, and closed
parts are added up by bucket in a keyed state with an event-time timer at the bucket's end. A late sample is dropped as the windowed aggregate drops it."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.buckets import parse_width, time_bucket, window_offset
from tidemark.streaming.workers import use_rocksdb

_OUT = "bucket_us long, avg_value double, max_value double, min_value double, sample_count long"


def _greater(a: float | None, b: float | None) -> float | None:
    """The greater as SQL has it: not-a-number is above all, null is nothing."""
    if a is None or b is None:
        return b if a is None else a
    return a if math.isnan(a) or (not math.isnan(b) and a >= b) else b


def _less(a: float | None, b: float | None) -> float | None:
    if a is None or b is None:
        return b if a is None else a
    return b if _greater(a, b) is a else a


class Bucket(StatefulProcessor):
    """Sum, counts and extremes of a bucket's parts; the bucket is given out when the watermark has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "sum double, valued long, high double, low double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        total, valued, high, low, n = self.total.get() if self.total.exists() else (0.0, 0, None, None, 0)
        end = None
        for r in rows:
            end = r.end_ms
            total, valued, n = total + (r.sum or 0.0), valued + r.valued, n + r.n
            high, low = _greater(high, r.high), _less(low, r.low)
        self.total.update((total, valued, high, low, n))
        if end is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        total, valued, high, low, n = self.total.get()
        self.total.clear()
        yield Row(bucket_us=key[0], avg_value=total / valued if valued else None, max_value=high, min_value=low, sample_count=n)

    def close(self) -> None:
        pass


def closed(metrics: DataFrame, width: str, watermark: str) -> DataFrame:
    """avg, max, min and count of a stream per bucket, for output mode append: bucket, avg_value, max_value, min_value, sample_count."""
    use_rocksdb(metrics.sparkSession)
    us, months = parse_width(width)
    part = "1 day" if months else width
    part_us, _ = parse_width(part)
    v = F.col("value")
    window = F.window("timestamp", f"{part_us} microseconds", f"{part_us} microseconds", window_offset(part))
    parts = metrics.withWatermark("timestamp", watermark).groupBy(window.alias("w")).agg(F.sum(v).alias("sum"), F.count(v).alias("valued"), F.max(v).alias("high"), F.min(v).alias("low"), F.count("*").alias("n"))
    start = F.col("w.start").cast("timestamp_ntz")
    bucket = time_bucket(width, start).cast("timestamp_ntz")
    end = F.timestamp_add("MONTH", F.lit(months), bucket) if months else F.timestamp_add("MICROSECOND", F.lit(us), bucket)
    rows = parts.select(F.unix_micros(bucket.cast("timestamp")).alias("bucket_us"), F.unix_millis(end.cast("timestamp")).alias("end_ms"), "sum", "valued", "high", "low", "n", F.window_time("w").alias("at"))
    out = rows.groupBy("bucket_us").transformWithState(Bucket(), _OUT, "Append", "EventTime")
    return out.select(F.timestamp_micros("bucket_us").alias("bucket"), "avg_value", "max_value", "min_value", "sample_count")
