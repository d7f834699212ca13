"""Registered queries over the driver's tables and their DuckDB forms."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.buckets import time_bucket
from tidemark.functions.tags import tag_hash
from tidemark.operators import agents as ag
from tidemark.operators import metrics as mq
from tidemark.operators import retention
from tidemark.operators import runs as rq
from tidemark.operators import tags as tq
from tidemark.operators.paging import By, walked
from tidemark.plans.fixtures import agents, metric_tags, metrics, metrics_of, runs, series, tags_dict
from tidemark.session import shared_dir
from tidemark.sources import exposition, store
from tidemark.sources.dictionary import Dictionary
from tidemark.streaming import ingest, workers

START, END = "2024-01-08 00:00:00", "2024-01-15 00:00:00"
NOW, MIDDAY = "2024-01-30 23:00:00", "2024-01-15 12:00:00"
PAIRS = [("k", "9"), ("k", "64"), ("agent_id", "5"), ("agent_id", "none")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BASE = {
    "metrics": """SELECT event_id AS id, event_type AS name, value, ts AS "timestamp", CAST(user_id AS VARCHAR) AS agent_id, json_extract_string(props, '$.k') AS k FROM events""",
    "pairs": "SELECT id AS metric_id, 'k' AS tag_key, k AS tag_value FROM metrics UNION ALL SELECT id, 'agent_id', agent_id FROM metrics",
    "tags_dict": "SELECT row_number() OVER (ORDER BY tag_key, tag_value) AS id, tag_key, tag_value FROM (SELECT DISTINCT tag_key, tag_value FROM pairs)",
    "metric_tags": "SELECT p.metric_id, d.id AS tag_dict_id FROM pairs p JOIN tags_dict d ON d.tag_key = p.tag_key AND d.tag_value = p.tag_value",
    "agents": """SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_mktsegment) || '-' || c_nationkey AS host, CAST(9090 + c_custkey % 10 AS INTEGER) AS port, '/metrics' AS path, 15 * (c_custkey % 3) AS scrape_interval_seconds,
        c_acctbal >= 0 AS enabled, 5 AS timeout_seconds, l.at AS last_scrape_at, CASE l.kind WHEN 'error' THEN 'failed: error' WHEN 'signup' THEN 'empty' ELSE CASE WHEN l.kind IS NOT NULL THEN 'success' END END AS last_scrape_status
        FROM customer LEFT JOIN (SELECT user_id, max(ts) AS at, arg_max(event_type, ts) AS kind FROM events GROUP BY user_id) l ON l.user_id = c_custkey WHERE c_custkey % 10 <> 7""",
    "runs": "SELECT CAST(user_id AS VARCHAR) AS agent_id, ts AS started_at, event_type = 'error' AS failed, CASE WHEN event_type = 'error' THEN 'error' END AS error, CAST(trunc(value) AS BIGINT) AS ms FROM events",
    "stats": """SELECT agent_id, count(*) AS total_runs, count(*) FILTER (NOT failed) AS successful_runs, count(*) FILTER (failed) AS failed_runs, max(started_at) AS last_run_at,
        arg_max_null(error, started_at) AS last_error, arg_max_null(CASE WHEN NOT failed THEN ms END, started_at) AS last_run_ms FROM runs GROUP BY agent_id""",
}
_ROW = 'id, name, value, "timestamp", agent_id'
_RANGE = f""""timestamp" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"""
_HASHED = "id, tag_key, tag_value"


def _sql(body: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _BASE.items()) + " " + body


def _query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _sql(sql)
        return f

    return add


# Time series


def _bucket_sql(width: str, more: str = "") -> str:
    return f"SELECT time_bucket(INTERVAL '{width}', \"timestamp\") AS bucket, avg(value) AS avg_value, max(value) AS max_value, min(value) AS min_value, count(*) AS sample_count FROM metrics WHERE name = 'error' AND {_RANGE} GROUP BY 1"


def _bucket_query(name: str, width: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mq.time_aggregation(metrics(spark, sf_dir), "error", START, END, width)

    f.__name__ = name
    _query(_bucket_sql(width))(f)


for _name, _width in (("time_aggregation", "1 hour"), ("time_aggregation_minute", "1 minute"), ("time_aggregation_7min", "7 minutes"), ("time_aggregation_5hour", "5 hours"), ("time_aggregation_7day", "7 days"), ("time_aggregation_month", "1 month")):
    _bucket_query(_name, _width)


@_query(None)
def stream_time_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = metrics_of(spark.readStream.schema(schema).parquet(f"{path}*"))
    kind = stream.schema["timestamp"].dataType.simpleString()
    rows = stream.where((F.col("name") == "error") & F.col("timestamp").between(F.lit(START).cast(kind), F.lit(END).cast(kind)))
    return ingest.drained(spark, ingest.aggregated(rows, "1 hour"), f"stream_{uuid.uuid4().hex}")


ORACLES["stream_time_aggregation"] = _sql(_bucket_sql("1 hour"))


@_query("SELECT o_orderkey, time_bucket(INTERVAL '3 months', o_orderdate) AS months3, time_bucket(INTERVAL '7 days', o_orderdate) AS days7, time_bucket(INTERVAL '5 hours', o_orderdate) AS hours5 FROM orders")
def bucket_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", time_bucket("3 months", at).cast("timestamp_ntz").alias("months3"), time_bucket("7 days", at).alias("days7"), time_bucket("5 hours", at).alias("hours5"))


# Ranges and tags


@_query(f"SELECT {_ROW} FROM metrics")
def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select(*mq.ROW)


@_query(f"SELECT {_ROW} FROM metrics WHERE id = 42")
def metric_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).where("id = 42").select(*mq.ROW).limit(1)


@_query("SELECT count(*) AS n FROM metrics")
def metric_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).agg(F.count("*").alias("n"))


@_query(f"SELECT {_ROW} FROM metrics WHERE agent_id = '5'")
def metrics_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_agent(metrics(spark, sf_dir), "5")


@_query(f"SELECT {_ROW} FROM metrics WHERE agent_id = '5' AND {_RANGE}")
def metrics_by_agent_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_agent_range(metrics(spark, sf_dir), "5", START, END)


@_query(f"SELECT {_ROW} FROM metrics WHERE name = 'error' AND {_RANGE}")
def metrics_by_name_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_name_range(metrics(spark, sf_dir), "error", START, END)


@_query(f"SELECT {_ROW} FROM metrics WHERE agent_id IN ('3', '5', '17') AND {_RANGE}")
def metrics_by_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_agents(metrics(spark, sf_dir), ["3", "5", "17"], START, END)


@_query(f"SELECT {_ROW} FROM metrics WHERE agent_id IN (SELECT id FROM agents WHERE enabled) AND {_RANGE}")
def metrics_by_agents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_agents(metrics(spark, sf_dir), agents(spark, sf_dir).where("enabled").select(F.col("id").alias("agent_id")), START, END)


_TAG = f"SELECT DISTINCT m.* EXCLUDE k FROM metrics m JOIN metric_tags t ON t.metric_id = m.id JOIN tags_dict d ON d.id = t.tag_dict_id WHERE name = 'error' AND d.tag_key = 'k' AND d.tag_value = '9' AND {_RANGE}"
_TWO = f"SELECT {_ROW} FROM metrics m WHERE name = 'error' AND EXISTS (SELECT 1 FROM pairs p WHERE p.metric_id = m.id AND tag_key = 'k' AND tag_value = '64') AND EXISTS (SELECT 1 FROM pairs p WHERE p.metric_id = m.id AND tag_key = 'agent_id' AND tag_value = '17')"
_KEY = f"SELECT DISTINCT m.* EXCLUDE k FROM metrics m JOIN pairs p ON p.metric_id = m.id WHERE p.tag_key = 'k' AND {_RANGE}"


@_query(_TAG)
def metrics_by_name_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_name_and_tag(metrics(spark, sf_dir), "error", "k", "9", START, END)


@_query(_TAG)
def metrics_by_name_tag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_name_and_tags_join(metrics(spark, sf_dir), metric_tags(spark, sf_dir), tags_dict(spark, sf_dir), "error", {"k": "9"}, START, END)


@_query(_TWO)
def metrics_by_two_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_name_and_tags(metrics(spark, sf_dir), "error", {"k": "64", "agent_id": "17"})


@_query(_TWO)
def metrics_by_two_tags_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_name_and_tags_join(metrics(spark, sf_dir), metric_tags(spark, sf_dir), tags_dict(spark, sf_dir), "error", {"k": "64", "agent_id": "17"})


@_query(_KEY)
def metrics_by_tag_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_tag_key(metrics(spark, sf_dir), "k", START, END)


@_query(_KEY)
def metrics_by_tag_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.by_tag_key_join(metrics(spark, sf_dir), metric_tags(spark, sf_dir), tags_dict(spark, sf_dir), "k", START, END)


@_query(_TAG)
def metrics_by_name_tag_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).by_name_and_tags("error", {"k": "9"}, START, END)


@_query(_TWO)
def metrics_by_two_tags_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).by_name_and_tags("error", {"k": "64", "agent_id": "17"})


@_query(_KEY)
def metrics_by_tag_key_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).by_tag_key("k", START, END)


@_query(f'SELECT {_ROW} FROM metrics WHERE agent_id = \'5\' ORDER BY "timestamp" DESC, id DESC LIMIT 1')
def last_metric_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.last_of_agent(metrics(spark, sf_dir), "5")


@_query(f'SELECT {_ROW} FROM metrics QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY "timestamp" DESC, id DESC) = 1')
def last_metric_all_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.last_of_all_agents(metrics(spark, sf_dir))


_BY_TAG = f"SELECT k AS tag_value, round(avg(value), 6) AS avg_value, count(*) AS sample_count FROM metrics WHERE name = 'error' AND {_RANGE} GROUP BY k"
_VALUES = f"SELECT tag_value, count(*) AS link_count FROM pairs JOIN metrics ON id = metric_id WHERE tag_key = 'agent_id' AND {_RANGE} GROUP BY tag_value"


@_query(_BY_TAG)
def aggregate_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.aggregate_by_tag(metrics(spark, sf_dir), "error", "k", START, END).withColumn("avg_value", F.round("avg_value", 6))


@_query(_BY_TAG)
def aggregate_by_tag_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).aggregate_by_tag("error", "k", START, END).withColumn("avg_value", F.round("avg_value", 6))


@_query(_VALUES)
def tag_value_distribution_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).tag_value_distribution("agent_id", START, END)


@_query(f'SELECT count(*) AS sample_count, round(avg(value), 6) AS avg_value, min("timestamp") AS first_at, max("timestamp") AS last_at FROM metrics WHERE agent_id = \'5\' AND {_RANGE}')
def agent_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.agent_window_stats(metrics(spark, sf_dir), "5", START, END).withColumn("avg_value", F.round("avg_value", 6))


@_query(f'SELECT count(*) AS sample_count, avg(value) AS avg_value, min("timestamp") AS first_at, max("timestamp") AS last_at FROM metrics WHERE agent_id = \'none\' AND {_RANGE}')
def agent_window_stats_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.agent_window_stats(metrics(spark, sf_dir), "none", START, END)


@_query(_VALUES)
def tag_value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.tag_value_distribution(metrics(spark, sf_dir), "agent_id", START, END)


@_query(f"SELECT {_ROW} FROM metrics WHERE \"timestamp\" >= TIMESTAMP '{END}'")
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.kept_after(metrics(spark, sf_dir), END)


@_query("SELECT m.id, m.agent_id, a.id IS NOT NULL AS agent_exists, a.host AS current_host, coalesce(a.enabled, false) AS is_active FROM metrics m LEFT JOIN agents a ON a.id = m.agent_id")
def metric_agent_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.agent_info(metrics(spark, sf_dir), agents(spark, sf_dir))


# Tag dictionary


@_query("SELECT DISTINCT tag_key FROM tags_dict")
def tag_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.keys(tags_dict(spark, sf_dir))


@_query("SELECT tag_value FROM tags_dict WHERE tag_key = 'k'")
def tag_values_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.values(tags_dict(spark, sf_dir), "k")


@_query(f"SELECT {_HASHED} FROM tags_dict WHERE tag_key = 'agent_id'")
def tags_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.by_key(tags_dict(spark, sf_dir), "agent_id").select("id", "tag_key", "tag_value")


@_query(f"SELECT {_HASHED} FROM tags_dict WHERE tag_key = 'k' AND tag_value = '9'")
def tag_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.by_pair(tags_dict(spark, sf_dir), "k", "9").select("id", "tag_key", "tag_value")


@_query(f"SELECT {_HASHED} FROM tags_dict WHERE (tag_key, tag_value) IN (('k', '9'), ('k', '64'), ('agent_id', '5'), ('agent_id', 'none'))")
def tags_by_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.by_pairs(tags_dict(spark, sf_dir), tq.pair_frame(spark, PAIRS)).select("id", "tag_key", "tag_value")


@_query(f"SELECT {_HASHED} FROM tags_dict WHERE tag_key = 'agent_id' AND tag_value LIKE '%1_3%'")
def tag_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.completions(tags_dict(spark, sf_dir), "agent_id", "1_3").select("id", "tag_key", "tag_value")


@_query("SELECT metric_id, tag_dict_id FROM metric_tags WHERE metric_id = 42")
def tag_links_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.links_of(metric_tags(spark, sf_dir), 42)


@_query("SELECT metric_id, tag_dict_id FROM metric_tags WHERE metric_id <> 42")
def tag_links_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.without_links_of(metric_tags(spark, sf_dir), 42)


@_query("""SELECT tag_key, tag_value, CASE WHEN h >= 2147483648 THEN '-' || lower(to_hex(4294967296 - h)) ELSE lower(to_hex(h)) END AS hash FROM (
    SELECT tag_key, tag_value, list_reduce(list_transform(list_prepend(NULL, string_split(tag_key || '=' || tag_value, '')), lambda c: coalesce(CAST(unicode(c) AS BIGINT), 0)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM tags_dict)""")
def tag_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = store.metric_tag_pairs(metrics(spark, sf_dir)).select("tag_key", "tag_value").distinct()
    return pairs.withColumn("hash", tag_hash(F.col("tag_key"), F.col("tag_value")))


@_query("SELECT tag_key, tag_value FROM tags_dict")
def tags_dictionary_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of all samples, filled by three batches of them; an id that two pairs share would take both away."""
    dictionary = Dictionary(spark, f"{shared_dir(spark)}/dictionary-{uuid.uuid4().hex}", 16)
    pairs = store.metric_tag_pairs(metrics(spark, sf_dir))
    for rule in ("metric_id % 3 = 0", "metric_id % 3 = 1", "true"):
        dictionary.add(pairs.where(rule).select("tag_key", "tag_value"))
    own = dictionary.rows().groupBy("id").agg(F.count("*").alias("n"), F.any_value("tag_key").alias("tag_key"), F.any_value("tag_value").alias("tag_value"))
    return own.where("n = 1").select("tag_key", "tag_value")


@_query("SELECT 'agent_id' AS tag_key, CAST(c_custkey AS VARCHAR) AS tag_value FROM customer WHERE NOT EXISTS (SELECT 1 FROM tags_dict WHERE tag_key = 'agent_id' AND tag_value = CAST(c_custkey AS VARCHAR))")
def tags_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("agent_id").alias("tag_key"), F.col("c_custkey").cast("string").alias("tag_value"))
    return tq.missing_pairs(wanted, tags_dict(spark, sf_dir))


@_query("SELECT metric_id, tag_dict_id FROM metric_tags")
def attach_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.attached(store.metric_tag_pairs(metrics(spark, sf_dir)), tags_dict(spark, sf_dir))


# Agents


def _agents_query(name: str, f: Callable[[DataFrame], DataFrame], rule: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(agents(spark, sf_dir)).drop("created_at", "updated_at")

    run.__name__ = name
    _query(f"SELECT * FROM agents {rule}")(run)


_agents_query("all_agents", lambda a: a, "")
_agents_query("agent_by_id", lambda a: ag.get(a, "5"), "WHERE id = '5'")
_agents_query("active_agents", ag.active, "WHERE enabled")
_agents_query("scrapable_agents", ag.scrapable, "WHERE enabled AND scrape_interval_seconds > 0")
_agents_query("agents_by_host", lambda a: ag.by_host(a, "auto%-1"), "WHERE host LIKE '%auto%-1%'")
_agents_query("agents_host_ci", lambda a: ag.find(a, True, "BUILD", 15), "WHERE enabled AND contains(lower(host), 'build') AND scrape_interval_seconds >= 15")
_agents_query("stale_agents", lambda a: ag.stale(a, "2024-01-29 00:00:00"), "WHERE enabled AND (last_scrape_at IS NULL OR last_scrape_at < TIMESTAMP '2024-01-29 00:00:00')")
_agents_query("agents_page_seek", lambda a: walked(a, [By("last_scrape_at", descending=True, nulls_first=True), By("id")], 10, 2), "ORDER BY last_scrape_at DESC NULLS FIRST, id LIMIT 10 OFFSET 20")
_agents_query("agents_page", lambda a: ag.page(a, 2, 10, F.desc_nulls_first("last_scrape_at")), "ORDER BY last_scrape_at DESC NULLS FIRST, id LIMIT 10 OFFSET 20")


@_query(f'SELECT {_ROW} FROM metrics ORDER BY value DESC, id LIMIT 25 OFFSET 50')
def metrics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.page(metrics(spark, sf_dir), 2, 25, F.desc("value")).select("id", "name", "value", "timestamp", "agent_id")


@_query(f'SELECT {_ROW} FROM metrics ORDER BY value DESC, id LIMIT 25 OFFSET 50')
def metrics_page_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(metrics(spark, sf_dir).select(*mq.ROW), [By("value", descending=True), By("id")], 25, 2)


@_query(f"SELECT {_HASHED} FROM tags_dict ORDER BY tag_value DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def tags_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.page(tags_dict(spark, sf_dir), 1, 20, F.desc_nulls_last("tag_value")).select("id", "tag_key", "tag_value")


@_query("SELECT metric_id, tag_dict_id FROM metric_tags ORDER BY metric_id DESC, tag_dict_id LIMIT 50 OFFSET 100")
def links_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.page(metric_tags(spark, sf_dir), 2, 50, F.desc("metric_id"), ties=("tag_dict_id",))


@_query("""SELECT CAST(count(*) AS INTEGER) AS total_agents, CAST(count(*) FILTER (enabled) AS INTEGER) AS enabled_agents, CAST(count(*) FILTER (NOT enabled) AS INTEGER) AS disabled_agents,
    CAST(count(*) FILTER (last_scrape_status = 'success') AS INTEGER) AS successful_scrapes, CAST(count(*) FILTER (last_scrape_status <> 'success') AS INTEGER) AS failed_scrapes, CAST(count(*) FILTER (last_scrape_at IS NULL) AS INTEGER) AS never_scraped FROM agents""")
def agents_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.stats(agents(spark, sf_dir))


@_query("SELECT count(*) FILTER (enabled) AS active, count(*) FILTER (NOT enabled) AS inactive, count(*) FILTER (last_scrape_status = 'success') AS successful, count(*) FILTER (last_scrape_status LIKE 'failed%') AS failed FROM agents")
def agent_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.status_counts(agents(spark, sf_dir))


# Workers


@_query("SELECT * FROM stats")
def worker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.worker_stats(runs(spark, sf_dir))


@_query("SELECT agent_id, last_error FROM stats WHERE last_error IS NOT NULL")
def worker_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.errors(rq.worker_stats(runs(spark, sf_dir)))


@_query("SELECT count(*) FILTER (last_error IS NOT NULL) AS total_errors, count(*) AS active_workers FROM stats")
def worker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.error_summary(rq.worker_stats(runs(spark, sf_dir)))


@_query("SELECT agent_id, failed_runs, CASE WHEN failed_runs <= 1 THEN 1 WHEN failed_runs <= 3 THEN 5 WHEN failed_runs <= 5 THEN 15 ELSE 30 END AS backoff_seconds FROM stats")
def worker_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.backoff(rq.worker_stats(runs(spark, sf_dir)))


@_query(f"SELECT agent_id, last_run_at FROM stats WHERE last_run_at < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE")
def stale_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.stale_workers(rq.worker_stats(runs(spark, sf_dir)), NOW)


@_query("SELECT id AS agent_id FROM agents WHERE enabled AND id NOT IN (SELECT agent_id FROM runs)")
def discovery_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.to_start(ag.active(agents(spark, sf_dir)), runs(spark, sf_dir).select("agent_id").distinct())


@_query("SELECT DISTINCT agent_id FROM runs WHERE agent_id NOT IN (SELECT id FROM agents WHERE enabled)")
def discovery_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.to_stop(ag.active(agents(spark, sf_dir)), runs(spark, sf_dir).select("agent_id").distinct())


@_query(f"SELECT a.id AS agent_id FROM agents a LEFT JOIN stats s ON s.agent_id = a.id WHERE a.enabled AND (s.last_run_at IS NULL OR s.last_run_at + to_seconds(scrape_interval_seconds) <= TIMESTAMP '{NOW}')")
def due_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.due(agents(spark, sf_dir), rq.worker_stats(runs(spark, sf_dir)), NOW)


@_query("SELECT a.id, CASE WHEN s.agent_id IS NULL THEN a.last_scrape_status WHEN s.last_error IS NOT NULL THEN 'failed: error' ELSE 'success' END AS last_scrape_status, coalesce(s.last_run_at, a.last_scrape_at) AS last_scrape_at FROM agents a LEFT JOIN stats s ON s.agent_id = a.id")
def scrape_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.with_latest_status(agents(spark, sf_dir), runs(spark, sf_dir)).select("id", "last_scrape_status", "last_scrape_at")


@_query("SELECT CAST(count(*) FILTER (NOT failed) AS BIGINT) AS samples, count(DISTINCT agent_id) AS agents, CAST(date_diff('millisecond', min(started_at), max(started_at + to_milliseconds(ms))) AS BIGINT) AS ms FROM runs")
def cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.cycle_summary(runs(spark, sf_dir))


@_query("SELECT * FROM stats")
def worker_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics as a keyed state that has followed the log as a stream."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    runs(spark, sf_dir).write.parquet(path)
    log = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    workers.start(log, f"{path}-state", None).awaitTermination()
    return workers.stats(spark, f"{path}-state").withColumn("last_run_at", F.col("last_run_at").cast("timestamp_ntz"))


# Stores


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body for each sample, scraped at its time."""
    rows = metrics(spark, sf_dir)
    return exposed(rows.withColumn("at", F.col("timestamp").cast("timestamp")), "at").select("agent_id", F.col("at").alias("scraped_at"), "body", F.lit(None).cast("string").alias("error"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of samples and runs after three rounds: one, another stream's of the same number, and the first again. The second's samples are those of agent 5 alone."""
    path = f"{shared_dir(spark)}/ingested-{uuid.uuid4().hex}"
    bodies = _bodies(spark, sf_dir)
    for stream, rows in (("a", bodies), ("b", bodies.where("agent_id = '5'")), ("a", bodies)):
        ingest.store_batch(rows, f"{path}/metrics", f"{path}/runs", stream, 0)
    return f"{path}/metrics", f"{path}/runs"


_TWICE = "(SELECT * FROM metrics UNION ALL SELECT * FROM metrics WHERE agent_id = '5')"


@_query(f"SELECT name, value, epoch_us(\"timestamp\") // 1000 AS millis, agent_id, k FROM {_TWICE}")
def ingested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.read_metrics(spark, _ingested(spark, sf_dir)[0])
    return rows.select("name", "value", F.unix_millis("timestamp").alias("millis"), "agent_id", F.col("tags").getItem("k").alias("k"))


@_query(f"SELECT agent_id, count(*) AS n_runs, CAST(count(*) AS BIGINT) AS n_samples, 'success' AS status FROM {_TWICE} GROUP BY agent_id")
def ingested_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(_ingested(spark, sf_dir)[1])
    return rows.groupBy("agent_id", "status").agg(F.count("*").alias("n_runs"), F.sum("n_samples").alias("n_samples")).select("agent_id", "n_runs", "n_samples", "status")


@_query(f"SELECT {_ROW} FROM metrics WHERE \"timestamp\" >= TIMESTAMP '{MIDDAY}'")
def stored_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after retention in the middle of a day, and after that day's files were made few."""
    path = f"{shared_dir(spark)}/retained-{uuid.uuid4().hex}"
    rows = metrics(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for rule in ("id % 2 = 0", "id % 2 = 1"):
        store.write_metrics(rows.where(rule), path)
    retention.delete_before(spark, path, datetime.datetime.fromisoformat(MIDDAY).replace(tzinfo=datetime.UTC))
    retention.compact_day(spark, path, MIDDAY[:10])
    return store.read_metrics(spark, path).select(*mq.ROW).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# Exposition format


def exposed(rows: DataFrame, *more: str) -> DataFrame:
    """A metrics table as bodies, one per sample: agent_id, body, and more of its columns."""
    millis = F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string")
    line = F.concat("name", F.lit('{k="'), F.col("tags").getItem("k"), F.lit('",id="'), F.col("id").cast("string"), F.lit('"} '), F.col("value").cast("string"), F.lit(" "), millis)
    return rows.select("agent_id", *more, F.concat(F.lit("# TYPE x gauge\n"), line, F.lit("\nbroken{ 1\n")).alias("body"))


@_query("SELECT id, name, value, epoch_us(\"timestamp\") // 1000 AS millis, agent_id, k FROM metrics")
def exposition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = exposition.parse(exposed(metrics(spark, sf_dir)))
    tag = lambda k: F.col("tags").getItem(k)
    return parsed.select(tag("id").cast("long").alias("id"), "name", "value", F.unix_millis("timestamp").alias("millis"), tag("agent_id").alias("agent_id"), tag("k").alias("k"))


@_query("SELECT 'Aa' AS tag_key, '1' AS tag_value, '1effd4' AS hash UNION ALL SELECT 'BB', '1', '1effd4' UNION ALL SELECT 'method', 'GET', '-2b22b9c6' UNION ALL SELECT 'code', '200', '-33c7943e'")
def tag_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("Aa", "1"), ("BB", "1"), ("method", "GET"), ("code", "200")], "tag_key string, tag_value string")
    return rows.withColumn("hash", tag_hash(F.col("tag_key"), F.col("tag_value")))
