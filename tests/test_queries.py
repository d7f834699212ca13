"""Every registered query against its SQL form on the smallest tables, and edge cases of the builders."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import agents as ag
from tidemark.operators import metrics as mq
from tidemark.operators import runs as rq
from tidemark.operators import tags as tq
from tidemark.plans import registered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows_of(frame):
    return sorted(tuple(None if x is None or x != x else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).values.tolist())


@needs_data
@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registered.ORACLES[name]).fetchdf()
    got = registered.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda x: repr(x)
    assert sorted(rows_of(got), key=key) == sorted(rows_of(want), key=key)


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [(1, "a", 1.0, "2024-01-01 00:00:00", "x", {"k": "1"}), (2, "a", 3.0, "2024-01-02 00:00:00", "x", {}), (3, "b", float("nan"), "2024-01-02 00:00:00", "y", {"k": "2"}), (4, "b", 5.0, "2024-01-02 00:00:01", "y", {"k": None})]
    df = spark.createDataFrame(rows, "id long, name string, value double, timestamp string, agent_id string, tags map<string,string>")
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_ranges_include_both_ends(metrics):
    assert ids(mq.by_agent_range(metrics, "x", "2024-01-01 00:00:00", "2024-01-02 00:00:00")) == [1, 2]
    assert ids(mq.by_agents(metrics, [], "2024-01-01 00:00:00", "2024-01-03 00:00:00")) == []


def test_orders(metrics):
    """Ranges and buckets come latest first, keys and values of tags in order."""
    for df, column in ((mq.by_agent_range(metrics, "x", "2024-01-01", "2024-01-03"), "timestamp"), (mq.by_agents(metrics, ["x", "y"], "2024-01-01", "2024-01-03"), "timestamp"), (mq.by_name_range(metrics, "b", "2024-01-01", "2024-01-03"), "timestamp"), (mq.time_aggregation(metrics, "a", "2024-01-01", "2024-01-03", "1 hour"), "bucket")):
        times = [r[column] for r in df.collect()]
        assert len(times) > 1 and times == sorted(times, reverse=True)


def test_latest_ties_and_absence(metrics):
    assert ids(mq.last_of_all_agents(metrics)) == [2, 4]
    assert mq.last_of_agent(metrics, "nobody").isEmpty()


def test_tags(metrics, spark):
    assert ids(mq.by_name_and_tags(metrics, "b", {"k": "2"})) == [3]
    assert ids(mq.by_tag_key(metrics, "k", "2024-01-01", "2024-01-03")) == [1, 3, 4]
    from tidemark.sources import store

    d = store.tags_dict(metrics.where("id < 4"))
    assert [(r.id, r.tag_value) for r in d.orderBy("id").collect()] == [(1, "1"), (2, "2")]
    more = tq.extended(d, tq.pair_frame(spark, [("k", "3"), ("k", "1"), ("a", "z"), ("k", "3")]))
    assert sorted((r.id, r.tag_key, r.tag_value) for r in more.collect()) == [(1, "k", "1"), (2, "k", "2"), (3, "a", "z"), (4, "k", "3")]


def test_numbers_of_pairs_over_many_ranges(spark):
    from tidemark.sources import store

    pairs = [("k" if i % 3 else f"k{i}", f"{i * 7919 % 5000:05d}") for i in range(5000)]
    want = {p: i for i, p in enumerate(sorted(pairs), 11)}
    frame = tq.pair_frame(spark, pairs).repartition(16)
    for _ in range(2):
        assert {(r.tag_key, r.tag_value): r.id for r in store.numbered(frame, 10).collect()} == want


def test_jdbc_store(spark):
    from tidemark.sources import store

    url, driver = "jdbc:derby:memory:tidemark;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, float(i) / 2, None if i == 3 else f"a{i}") for i in range(250)], "id long, value double, agent_id string")
    store.write_jdbc(rows.where("id < 100"), url, "samples", driver)
    store.write_jdbc(rows.where("id >= 100"), url, "samples", driver)
    assert sorted(map(tuple, store.read_jdbc(spark, url, "samples", properties=driver).collect())) == sorted(map(tuple, rows.collect()))
    cut = store.read_jdbc(spark, url, "samples", "id", (0, 250), 5, driver)
    assert cut.rdd.getNumPartitions() == 5 and cut.where("id between 90 and 110").count() == 21


def test_nan_and_empty_aggregates(metrics):
    (row,) = mq.bucketed(metrics.where("name = 'b'"), "1 day").collect()
    assert row.max_value != row.max_value and row.sample_count == 2
    none = mq.agent_window_stats(metrics, "nobody", "2024-01-01", "2024-01-03").first()
    assert (none.sample_count, none.avg_value, none.first_at) == (0, None, None)


def test_host_searches_differ(spark):
    a = spark.createDataFrame([("1", "Web_1", True, 15), ("2", "web11", False, 0)], "id string, host string, enabled boolean, scrape_interval_seconds long")
    assert ids(ag.by_host(a, "b_1")) == ["1", "2"] and ids(ag.find(a, host="B_1")) == ["1"]
    assert ids(ag.find(a)) == ["1", "2"] and ids(ag.find(a, enabled=True, min_interval=15)) == ["1"]


def test_an_error_is_cleared_by_success(spark):
    runs = spark.createDataFrame([("a", "2024-01-01 00:00:00", "2024-01-01 00:00:01", 0, "e"), ("a", "2024-01-01 00:01:00", "2024-01-01 00:01:02", 3, None)], "agent_id string, s string, f string, n_samples long, error string").selectExpr("agent_id", "cast(s as timestamp) started_at", "cast(f as timestamp) finished_at", "n_samples", "error")
    r = rq.worker_stats(runs).first()
    assert (r.total_runs, r.failed_runs, r.last_error, r.last_run_ms) == (2, 1, None, 2000)


@pytest.mark.parametrize("first,last", [("2024-01-01 00:00:00.000900", "2024-01-01 00:00:01.000100"), ("2024-01-01 00:00:00.000100", "2024-01-01 00:00:00.001900"), ("1969-12-31 23:59:59.998500", "1970-01-01 00:00:00.000500")])
def test_a_rounds_milliseconds_are_those_of_date_diff(spark, first, last):
    runs = spark.createDataFrame([("a", first, first, 1), ("b", first, last, 2)], "agent_id string, s string, f string, n_samples long").selectExpr("agent_id", "cast(s as timestamp) started_at", "cast(f as timestamp) finished_at", "n_samples")
    want = duckdb.execute(f"SELECT date_diff('millisecond', TIMESTAMP '{first}', TIMESTAMP '{last}')").fetchone()[0]
    assert tuple(rq.cycle_summary(runs).first()) == (3, 2, want)


def test_range_on_a_partitioned_store_prunes(spark, tmp_path, metrics):
    from tidemark.sources import store

    store.write_metrics(metrics, str(tmp_path / "m"))
    df = mq.by_name_range(store.read_metrics(spark, str(tmp_path / "m")), "a", "2024-01-02 00:00:00", "2024-01-02 12:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(name)" in plan
    assert ids(df) == [2]
