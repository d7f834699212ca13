"""The series store against the map form, and what it doesn't read."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as mq
from tidemark.plans import fixtures
from tidemark.sources.series import SeriesStore

START, END = "2024-01-01 00:00:00", "2024-01-04 12:00:00"


@pytest.fixture(scope="module")
def metrics(spark):
    k = F.col("id")
    tags = F.when(k % 7 == 0, F.create_map()).when(k % 7 == 1, F.lit(None).cast("map<string,string>")).when(k % 7 == 2, F.create_map(F.lit("k"), F.lit(None).cast("string"))).otherwise(
        F.create_map(F.lit("k"), (k % 5).cast("string"), F.lit("host"), (k % 40).cast("string"))
    )
    at = F.timestamp_add("MINUTE", (k * 11).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return spark.range(600).select("id", F.concat(F.lit("m"), (k % 3).cast("string")).alias("name"), (k / 4).alias("value"), at.alias("timestamp"), (k % 6).cast("string").alias("agent_id"), tags.alias("tags")).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(store, metrics):
    assert rows(store.by_name_and_tags("m0", {"k": "3"}, START, END)) == rows(mq.by_name_and_tags(metrics, "m0", {"k": "3"}, START, END)) != []
    assert rows(store.by_name_and_tags("m1", {"k": "3", "host": "13"})) == rows(mq.by_name_and_tags(metrics, "m1", {"k": "3", "host": "13"})) != []
    assert rows(store.by_name_and_tags("m1", {"k": "none"})) == []
    assert rows(store.by_tag_key("k", START, END)) == rows(mq.by_tag_key(metrics, "k", START, END)) != []
    assert rows(store.aggregate_by_tag("m0", "k", START, END)) == rows(mq.aggregate_by_tag(metrics, "m0", "k", START, END)) != []
    assert rows(store.tag_value_distribution("k", START, END)) == rows(mq.tag_value_distribution(metrics, "k", START, END)) != []
    assert rows(store.metrics().withColumn("tags", F.map_entries("tags"))) == rows(metrics.select(*mq.ROW, F.map_entries("tags").alias("tags")))


def test_answers_and_new_series(spark, tmp_path, metrics, monkeypatch):
    store = SeriesStore(spark, str(tmp_path / "s"), 8)
    store.add(metrics.where("id < 300"))
    first = store.series().count()
    store.add(metrics.where("id >= 300"))
    assert first < store.series().count() == store.series().select("series_id").distinct().count()
    check(store, metrics)
    monkeypatch.setattr("tidemark.sources.series.BROADCAST_SERIES", 0)  # and as shuffles
    check(store, metrics)


def test_rounds_replace_themselves_and_old_points_go(spark, tmp_path, metrics, monkeypatch):
    """A round that broke off after any of its tables is added again; retention leaves what a filter leaves."""
    from tidemark.sources import series, store

    s = SeriesStore(spark, str(tmp_path / "s"), 4)
    s.add(metrics.where("id < 200"), "a")
    for k in (1, 2, 3):
        calls = []

        def broken(*args):
            store.replaced(*args)
            calls.append(args)
            if len(calls) == k:
                raise KeyboardInterrupt

        monkeypatch.setattr(series, "replaced", broken)
        with pytest.raises(KeyboardInterrupt):
            s.add(metrics.where("id >= 200"), f"b{k if k < 3 else 1}")
        monkeypatch.undo()
        s.add(metrics.where("id >= 200"), f"b{k if k < 3 else 1}")
        if k == 1:
            check(s, metrics)
    assert s.series().count() == s.series().select("series_id").distinct().count() and s.pairs().count() == s.pairs().distinct().count()
    at = datetime.datetime(2024, 1, 3, 6, tzinfo=datetime.UTC)
    s.delete_before(at)
    kept = [r.id for r in s.points().where("round <> 'b2' and round not like 'kept%'").collect()]
    assert len(kept) == len(set(kept))
    assert s.points().select("id").distinct().count() == metrics.where(F.col("timestamp") >= F.lit("2024-01-03 06:00:00").cast("timestamp")).count()
    assert s.points().where(F.col("timestamp") < F.lit("2024-01-03 06:00:00").cast("timestamp")).isEmpty()


def test_a_hash_of_two_series_is_an_error(spark, tmp_path, metrics, monkeypatch):
    from tidemark.sources import series

    monkeypatch.setattr(series, "series_of", lambda m, n: m.withColumn("series_id", F.lit(1).cast("long")).withColumn("bucket", F.lit(1)))
    store = SeriesStore(spark, str(tmp_path / "s"), 8)
    with pytest.raises(ValueError, match="one hash"):
        store.add(metrics)
    assert not (tmp_path / "s").exists()


def files_read(df):
    """How many files the scan of points read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    node = df._jdf.queryExecution().executedPlan()
    todo, found = [node], 0
    while todo:
        n = todo.pop()
        if n.nodeName() == "AdaptiveSparkPlan":
            todo.append(n.executedPlan())
        elif hasattr(n, "plan") and "QueryStage" in n.nodeName():
            todo.append(n.plan())
        children = n.children()
        todo += [children.apply(k) for k in range(children.size())]
        if n.nodeName().startswith("Scan parquet") and "timestamp" in n.simpleString(500):
            found += n.metrics().apply("numFiles").value()
    return found, plan


def test_buckets_of_other_series_are_not_read(spark, tmp_path, metrics):
    store = SeriesStore(spark, str(tmp_path / "s"), 16)
    store.add(metrics)
    few, plan = files_read(store.by_name_and_tags("m1", {"k": "3", "host": "13"}))
    many, _ = files_read(store.by_tag_key("k", "2024-01-01 00:00:00", "2025-01-01 00:00:00"))
    assert "dynamicpruning" in plan.lower() and 0 < few < many / 4
    day, plan = files_read(store.by_tag_key("k", "2024-01-02 00:00:00", "2024-01-02 12:00:00"))
    assert "date" in plan and day < many / 2


def test_views_follow_their_source(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(50).write.parquet(str(tmp_path / "events.parquet"))
    n = fixtures.tags_dict(spark, str(tmp_path)).count()
    assert fixtures.tags_dict(spark, str(tmp_path)).count() == n
    events.write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert fixtures.tags_dict(spark, str(tmp_path)).count() > n
    assert fixtures.series(spark, str(tmp_path)).points().count() == events.count()
