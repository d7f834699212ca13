import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.buckets import parse_width, time_bucket, window_offset
from tidemark.functions.tags import tag_hash


@pytest.mark.parametrize("width,want", [("1 minute", "2024-01-17 13:37:00"), ("7 minutes", "2024-01-17 13:36:00"), ("1 hour", "2024-01-17 13:00:00"), ("5 hours", "2024-01-17 10:00:00"), ("1 day", "2024-01-17 00:00:00"), ("7 days", "2024-01-15 00:00:00"), ("1 month", "2024-01-01 00:00:00"), ("250 milliseconds", "2024-01-17 13:37:11.5")])
def test_bucket_vectors(spark, width, want):
    ts = F.lit("2024-01-17 13:37:11.5").cast("timestamp_ntz")
    assert spark.range(1).select(time_bucket(width, ts).alias("b")).first().b == datetime.datetime.fromisoformat(want)


def test_before_the_origin(spark):
    ts = F.lit("1995-06-07 01:00:00").cast("timestamp_ntz")
    got = spark.range(1).select(time_bucket("7 days", ts).alias("a"), time_bucket("12 months", ts).alias("b")).first()
    assert got.a == datetime.datetime(1995, 6, 5) and got.b == datetime.datetime(1995, 1, 1)


def test_widths():
    assert parse_width("1 minute") == (60_000_000, 0) and parse_width("2 years") == (0, 24) and parse_width("0.25 seconds") == (250_000, 0)
    for bad in ("", "minute", "0 seconds", "1 fortnight", "1.5 months", "-1 day"):
        with pytest.raises(ValueError):
            parse_width(bad)
    assert window_offset("7 days") == f"{946_857_600 % 604_800 * 1_000_000} microseconds"


def test_hash_vectors(spark):
    rows = spark.createDataFrame([("method", "GET", "-2b22b9c6"), ("code", "200", "-33c7943e"), ("Aa", "1", "1effd4"), ("BB", "1", "1effd4"), ("x", "\U0001f600", "527ee8")], "k string, v string, want string")
    for r in rows.withColumn("got", tag_hash(F.col("k"), F.col("v"))).collect():
        assert r.got == r.want
