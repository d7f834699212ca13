"""The engine's service surface as Python calls: agents, scrapers, samples. An HTTP layer can map routes onto it one to one."""

from __future__ import annotations

import datetime
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import agents as agent_queries
from tidemark.operators import metrics as metric_queries
from tidemark.operators import retention, runs
from tidemark.operators.registry import Agent, Missing, Registry
from tidemark.schema import METRICS, SCRAPE_RUNS
from tidemark.sources import scrape, store
from tidemark.sources.files import Files
from tidemark.sources.series import SeriesStore
from tidemark.streaming import ingest, workers


class Status(NamedTuple):
    """What the scrapers' status answers: one row (total_errors, active_workers, total_agents), and a row for each worker."""

    summary: DataFrame
    workers: DataFrame


class Service:
    """Everything under one folder: registry, samples, log of runs, stream checkpoints."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root, Files(spark, root)
        self.registry = Registry(spark, f"{root}/agents_log")
        self.metrics_path, self.runs_path = f"{root}/metrics", f"{root}/scrape_runs"
        self.stopped_path, self.series = f"{root}/stopped", SeriesStore(spark, f"{root}/series")
        self.query: StreamingQuery | None = None
        self.watch: StreamingQuery | None = None

    def _table(self, path: str, schema) -> DataFrame:  # noqa: ANN001
        return self.spark.read.schema(schema).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], schema)

    def stopped(self) -> set[str]:
        """Agents that rounds leave out, kept as files by the id's hexadecimal name: they outlive this process."""
        return {bytes.fromhex(n).decode() for n in self.files.names(self.stopped_path)}

    def metrics(self) -> DataFrame:
        return self._table(self.metrics_path, METRICS)

    def runs(self) -> DataFrame:
        return self._table(self.runs_path, SCRAPE_RUNS)

    # Agents

    def agents(self, enabled: bool | None = None, host: str | None = None, min_interval: int | None = None) -> DataFrame:
        """Agents by optional criteria, with time and status of their latest run."""
        return agent_queries.find(runs.with_latest_status(self.registry.agents(), self.runs()), enabled, host, min_interval)

    def agent(self, agent_id: str) -> Agent:
        found = self.registry.get(agent_id)
        if found is None:
            raise Missing(agent_id)
        return found

    def create(self, agent: Agent) -> Agent:
        return self.registry.add(agent)

    def update(self, agent: Agent) -> Agent:
        return self.registry.update(agent)

    def rename(self, agent_id: str, new_id: str) -> Agent:
        return self.registry.rename(agent_id, new_id)

    def toggle(self, agent_id: str, enabled: bool) -> Agent:
        return self.registry.enable(agent_id, enabled)

    def delete(self, agent_id: str, hard: bool = False) -> None:
        self.registry.delete(agent_id, hard)

    def stats(self) -> DataFrame:
        return agent_queries.stats(self.agents())

    # Scrapers

    def scraper_stats(self) -> DataFrame:
        """Per agent: runs, successes, failures and the last run. While rounds go on, from the state that follows the log; else from the log itself."""
        return workers.stats(self.spark, f"{self.root}/worker-state") if self.watch is not None and self.watch.lastProgress else runs.worker_stats(self.runs())

    def scraper_status(self) -> Status:
        """Totals and the workers that they count, of one look at the statistics."""
        stats = self.scraper_stats()
        return Status(runs.error_summary(stats).withColumn("total_agents", F.col("active_workers")), stats)

    def scraper_errors(self) -> DataFrame:
        return runs.errors(self.scraper_stats())

    def scrape_now(self, agent_id: str | None = None) -> dict[str, int]:
        """One round over all enabled agents, or over one."""
        targets = self.registry.agents()
        if agent_id is not None:
            targets = targets.where(F.col("id") == self.agent(agent_id).id)
        return ingest.store_batch(scrape.scrape(self.spark, targets), self.metrics_path, self.runs_path, series=self.series)

    def scrape_due(self, now: datetime.datetime | None = None) -> dict[str, int]:
        """One round over the agents whose own interval has passed since their last run, but those that are stopped."""
        at = retention.utc_text(now or datetime.datetime.now(datetime.UTC))
        due = runs.due(self.registry.agents(), self.scraper_stats(), at).withColumnRenamed("agent_id", "id")
        targets = self.registry.agents().join(due, "id", "left_semi").where(~F.col("id").isin(*self.stopped()))
        return ingest.store_batch(scrape.scrape(self.spark, targets), self.metrics_path, self.runs_path, series=self.series)

    def start(self, every: str = "30 seconds") -> StreamingQuery:
        """Rounds over due agents until stop(), and the statistics that follow them. Each round reads the registry anew, so new agents join and disabled ones leave; executors fetch, MAX_CONCURRENT at once."""
        bodies = scrape.rounds(self.spark, self.registry.path, f"{self.root}/bodies", self.stopped_path)
        self.query = ingest.start(bodies, self.metrics_path, self.runs_path, f"{self.root}/checkpoint", every, self.series)
        self.files.fs.mkdirs(self.files.path(self.runs_path))
        self.watch = workers.start(self.spark.readStream.schema(SCRAPE_RUNS).parquet(self.runs_path), f"{self.root}/worker-state", every)
        return self.query

    def stop(self, agent_id: str | None = None) -> None:
        """Stop all rounds, or leave out one agent from the next on."""
        if agent_id is not None:
            self.files.create(f"{self.stopped_path}/{self.agent(agent_id).id.encode().hex()}", "")
            return
        for query in (self.query, self.watch):
            if query is not None:
                query.stop()
        self.query = self.watch = None

    def restart(self, agent_id: str | None = None, every: str = "30 seconds") -> StreamingQuery | None:
        """Restart all rounds, or scrape one agent now and take it into the rounds again."""
        if agent_id is not None:
            self.files.delete(f"{self.stopped_path}/{agent_id.encode().hex()}")
            self.scrape_now(agent_id)
            return self.query
        self.stop()
        return self.start(every)

    def cycle(self, since: datetime.datetime) -> DataFrame:
        """Samples, agents and milliseconds of the runs since a time."""
        return runs.cycle_summary(self.runs().where(F.col("started_at") >= F.lit(retention.utc_text(since)).cast("timestamp")))

    def self_metrics(self) -> DataFrame:
        """Figures of the engine's own rounds: samples, agents, failures, time taken."""
        return ingest.rounds(self.spark, self.runs_path)

    # Samples

    def save_metric(self, name: str, value: float, agent_id: str, tags: dict[str, str] | None = None, at: datetime.datetime | None = None) -> None:
        """One sample, with its tags."""
        ident = uuid.uuid4().int >> 65
        row = self.spark.createDataFrame([(ident, name, float(value), at or datetime.datetime.now(), agent_id, {**(tags or {}), "agent_id": agent_id})], "id long, name string, value double, timestamp timestamp, agent_id string, tags map<string,string>")
        name = f"own-{ident}"
        store.write_metrics(row, self.metrics_path, name)
        self.series.add(row, name)

    def search(self, name: str, tags: dict[str, str], start: str, end: str) -> DataFrame:
        """Samples of a name with all of tags in a range. The tag index finds their series, and only the buckets of these are read."""
        return self.series.by_name_and_tags(name, tags, start, end)

    def agent_metrics(self, agent_id: str, start: str, end: str) -> DataFrame:
        """Samples of an agent, of one deleted meanwhile too."""
        return metric_queries.by_agent_range(self.metrics(), agent_id, start, end)

    def delete_before(self, threshold: datetime.datetime) -> list[str]:
        """Samples before a threshold go, from the series store too. Returns the days that went whole."""
        self.series.delete_before(threshold)
        return retention.delete_before(self.spark, self.metrics_path, threshold)

    def compact_day(self, day: str) -> int:
        """The files of one day's rounds as few."""
        return retention.compact_day(self.spark, self.metrics_path, day)
