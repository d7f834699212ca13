"""Queries over the agents' registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(agents: DataFrame, agent_id: str) -> DataFrame:
    return agents.where(F.col("id") == agent_id).limit(1)


def exists(agents: DataFrame, agent_id: str) -> bool:
    return not get(agents, agent_id).isEmpty()


def active(agents: DataFrame) -> DataFrame:
    return agents.where("enabled")


def scrapable(agents: DataFrame) -> DataFrame:
    return agents.where(F.col("enabled") & (F.col("scrape_interval_seconds") > 0))


def by_host(agents: DataFrame, pattern: str) -> DataFrame:
    """Hosts with pattern in them, case-sensitive; % and _ in it are wildcards."""
    return agents.where(F.col("host").like(f"%{pattern}%"))


def stale(agents: DataFrame, threshold: str) -> DataFrame:
    """Enabled agents never scraped, or last before the threshold."""
    kind = agents.schema["last_scrape_at"].dataType.simpleString()
    return agents.where(F.col("enabled") & (F.col("last_scrape_at").isNull() | (F.col("last_scrape_at") < F.lit(threshold).cast(kind))))


def find(agents: DataFrame, enabled: bool | None = None, host: str | None = None, min_interval: int | None = None) -> DataFrame:
    """Agents by optional criteria; host is a part of the name, taken literally and without regard to case."""
    rules: list[Column] = []
    if enabled is not None:
        rules.append(F.col("enabled") == enabled)
    if host is not None:
        rules.append(F.contains(F.lower("host"), F.lower(F.lit(host))))
    if min_interval is not None:
        rules.append(F.col("scrape_interval_seconds") >= min_interval)
    for rule in rules:
        agents = agents.where(rule)
    return agents


def page(rows: DataFrame, number: int, size: int, *order: Column, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """A page of rows (agents, metrics, tags; links by their two columns) in an order; ties breaks what it leaves open."""
    return rows.orderBy(*order, *ties).offset(number * size).limit(size)


def stats(agents: DataFrame) -> DataFrame:
    """Six counts in one pass. Failed are all whose last scrape isn't a success, empty ones too."""
    status = F.col("last_scrape_status")
    counts = {
        "total_agents": F.count("*"), "enabled_agents": F.count_if("enabled"), "disabled_agents": F.count_if(~F.col("enabled")),
        "successful_scrapes": F.count_if(status == "success"), "failed_scrapes": F.count_if(status.isNotNull() & (status != "success")), "never_scraped": F.count_if(F.col("last_scrape_at").isNull()),
    }
    return agents.agg(*(c.cast("int").alias(n) for n, c in counts.items()))


def status_counts(agents: DataFrame) -> DataFrame:
    """Counts of active, inactive, successful and failed agents; failed are those whose status begins with the word."""
    status = F.col("last_scrape_status")
    return agents.agg(F.count_if("enabled").alias("active"), F.count_if(~F.col("enabled")).alias("inactive"), F.count_if(status == "success").alias("successful"), F.count_if(F.startswith(status, F.lit("failed"))).alias("failed"))
