"""Worker statistics over the log of scrape runs: agent_id, started_at, finished_at, n_samples, status, error (null if it went well)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Failures in all up to which each wait holds, in seconds; more wait LONGEST.
BACKOFF, LONGEST = ((1, 1), (3, 5), (5, 15)), 30


def status(n_samples: Column, error: Column) -> Column:
    """Status of a run: failed: its error, empty, or success."""
    return F.when(error.isNotNull(), F.concat(F.lit("failed: "), error)).when(F.coalesce(n_samples, F.lit(0)) == 0, "empty").otherwise("success")


def worker_stats(runs: DataFrame) -> DataFrame:
    """Per agent: runs, successes and failures, the last run's time, error (none if it went well) and duration (none if it failed)."""
    failed = F.col("error").isNotNull()
    took = F.when(~failed, (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("long")
    last = F.struct("started_at", "finished_at")
    return runs.groupBy("agent_id").agg(
        F.count("*").alias("total_runs"), F.count_if(~failed).alias("successful_runs"), F.count_if(failed).alias("failed_runs"),
        F.max("started_at").alias("last_run_at"), F.max_by("error", last).alias("last_error"), F.max_by(took, last).alias("last_run_ms"),
    )


def errors(stats: DataFrame) -> DataFrame:
    """Agents whose last run failed."""
    return stats.where("last_error is not null").select("agent_id", "last_error")


def error_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count_if(F.col("last_error").isNotNull()).alias("total_errors"), F.count("*").alias("active_workers"))


def cycle_summary(runs: DataFrame) -> DataFrame:
    """Of the runs of a round: samples, agents and milliseconds from the first start to the last end, by the clock's whole milliseconds, as date_diff counts them."""
    took = F.unix_millis(F.max("finished_at").cast("timestamp")) - F.unix_millis(F.min("started_at").cast("timestamp"))
    return runs.agg(F.coalesce(F.sum("n_samples"), F.lit(0)).alias("samples"), F.count_distinct("agent_id").alias("agents"), took.alias("ms"))


def stale_workers(stats: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    """Workers whose last run is more than minutes before now."""
    kind = stats.schema["last_run_at"].dataType.simpleString()
    return stats.where(F.col("last_run_at") < F.timestamp_add("MINUTE", F.lit(-minutes), F.lit(now).cast(kind))).select("agent_id", "last_run_at")


def backoff(stats: DataFrame) -> DataFrame:
    """Seconds to wait after the failures so far, all counted, in a row or not."""
    n, wait = F.col("failed_runs"), None
    for most, seconds in BACKOFF:
        wait = F.when(n <= most, seconds) if wait is None else wait.when(n <= most, seconds)
    return stats.select("agent_id", "failed_runs", wait.otherwise(LONGEST).cast("int").alias("backoff_seconds"))


def to_start(active: DataFrame, workers: DataFrame) -> DataFrame:
    """Active agents without a worker."""
    return active.select(F.col("id").alias("agent_id")).join(workers.select("agent_id"), "agent_id", "left_anti")


def to_stop(active: DataFrame, workers: DataFrame) -> DataFrame:
    """Workers without an active agent."""
    return workers.select("agent_id").join(active.select(F.col("id").alias("agent_id")), "agent_id", "left_anti")


def due(agents: DataFrame, stats: DataFrame, now: str) -> DataFrame:
    """Active agents whose interval has passed since their last run, or that never ran."""
    last = stats.select(F.col("agent_id").alias("id"), "last_run_at")
    kind = stats.schema["last_run_at"].dataType.simpleString()
    rows = agents.where("enabled").join(last, "id", "left")
    return rows.where(F.col("last_run_at").isNull() | (F.timestamp_add("SECOND", F.col("scrape_interval_seconds"), F.col("last_run_at")) <= F.lit(now).cast(kind))).select(F.col("id").alias("agent_id"))


def with_latest_status(agents: DataFrame, runs: DataFrame) -> DataFrame:
    """agents with time and status of their latest run; those without a run keep what they have."""
    latest = runs.groupBy(F.col("agent_id").alias("id")).agg(F.max("started_at").alias("at"), F.max_by(status(F.col("n_samples"), F.col("error")), "started_at").alias("run_status"))
    rows = agents.join(latest, "id", "left")
    return rows.select(*(F.coalesce("at", c).alias(c) if c == "last_scrape_at" else F.when(F.col("at").isNotNull(), F.col("run_status")).otherwise(F.col(c)).alias(c) if c == "last_scrape_status" else F.coalesce("at", c).alias(c) if c == "updated_at" else F.col(c) for c in agents.columns))
