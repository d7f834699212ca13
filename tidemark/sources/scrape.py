"""HTTP pull source. Bodies are rows (agent_id, scraped_at, body, error); a failed scrape is a row with its error and an empty body.

A partition's agents are a queue from which a bounded pool of threads takes the next one, so a slow agent holds one permit and no other agent waits behind
it; partitions times permits is the number of scrapes that run at once.

As a stream, an offset is a time. The agents that are due between two offsets are read from the registry when a batch is planned: an agent with an interval is
due when a multiple of it (shifted by a hash of its id, so that agents spread out) has passed. What a task has fetched is kept in a file until the batch is committed, and the first
attempt's file counts: a task or batch that runs again gives the same rows, whatever the agents show by then."""

from __future__ import annotations

import concurrent.futures
import datetime
import json
import time
import urllib.request
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Scrapes at once in all, permits of one task, and seconds to wait for an answer.
MAX_CONCURRENT, PERMITS, TIMEOUT_SECONDS = 10, 10, 5
_SCHEMA = "agent_id string, scraped_at timestamp, body string, error string"


def fetch(agent: dict) -> tuple[str, datetime.datetime, str, str | None]:
    at = datetime.datetime.now(datetime.UTC)
    try:
        with urllib.request.urlopen(f"http://{agent['host']}:{agent['port']}{agent['path']}", timeout=agent.get("timeout_seconds") or TIMEOUT_SECONDS) as reply:
            return agent["id"], at, reply.read().decode("utf-8", "replace"), None
    except Exception as e:  # noqa: BLE001  whatever fails is that agent's status
        return agent["id"], at, "", f"{type(e).__name__}: {e}"


def fetched(agents: list[dict], permits: int) -> Iterator[tuple]:
    """Bodies of agents in the order in which they arrive, at most so many fetched at once."""
    with concurrent.futures.ThreadPoolExecutor(permits) as pool:
        for done in concurrent.futures.as_completed([pool.submit(fetch, a) for a in agents]):
            yield done.result()


class Group(InputPartition):
    """Agents of a task, its permits, and the file that keeps what it fetched (none for a batch)."""

    def __init__(self, agents: list[dict], permits: int, kept: str | None = None) -> None:
        self.agents, self.permits, self.kept = agents, permits, kept


def dealt(agents: list[dict], at_once: int, folder: str | None = None) -> list[Group]:
    """Agents over tasks of at most PERMITS permits each; at_once in all."""
    n = max(1, min(-(-at_once // PERMITS), len(agents)))
    return [Group(agents[k::n], at_once // n + (k < at_once % n), folder and f"{folder}/part-{k:05d}.json") for k in range(n)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return dealt(json.loads(self.options["agents"]), int(self.options.get("max_concurrent", MAX_CONCURRENT)))

    def read(self, partition: Group) -> Iterator[tuple]:
        yield from fetched(partition.agents, partition.permits)


def registered(path: str) -> list[dict]:
    """The agents of a registry's log, read without Spark, as a source's planner must. A compaction beside it only makes it read again."""
    for _ in range(10):
        system, root = pyarrow.fs.FileSystem.from_uri(path)
        last: dict[str, dict] = {}
        try:
            for info in system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
                if info.base_name.endswith(".json") and not info.base_name.startswith("_"):
                    with system.open_input_stream(info.path) as f:
                        for line in f.read().decode().splitlines():
                            change = json.loads(line)
                            if change["seq"] >= last.get(change["id"], change)["seq"]:
                                last[change["id"]] = change
        except FileNotFoundError:
            continue
        return [c for c in last.values() if c["op"] == "put" and c["enabled"]]
    raise FileNotFoundError(path)


def due(agent: dict, start: int, end: int) -> bool:
    """Whether an agent is due between two times in milliseconds, the first not included. Without an interval it is due always, and so is one since time 0."""
    every = int(agent["scrape_interval_seconds"] or 0) * 1000
    if every <= 0 or start <= 0:
        return True
    shift = zlib.crc32(agent["id"].encode()) % every
    return (end + shift) // every > (start + shift) // every


class _StreamReader(DataSourceStreamReader):
    """Options: registry (the log's folder), kept (a folder for bodies until their batch is committed), stopped (a folder with a file for each agent that is left out), max_concurrent."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": int(time.time() * 1000)}

    def _stopped(self) -> set[str]:
        if "stopped" not in self.options:
            return set()
        system, root = pyarrow.fs.FileSystem.from_uri(self.options["stopped"])
        return {bytes.fromhex(i.base_name).decode() for i in system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if not i.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The tasks of a batch. They are written down when it is first planned, so that a batch that is planned again has the same."""
        folder = f"{self.options['kept']}/{end['at']}"
        plan = f"{folder}/plan.json"
        system, path = pyarrow.fs.FileSystem.from_uri(plan)
        if system.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            left_out = self._stopped()
            agents = [a for a in registered(self.options["registry"]) if a["id"] not in left_out and due(a, start["at"], end["at"])]
            _keep(plan, json.dumps(sorted(agents, key=lambda a: a["id"])))
        with system.open_input_stream(path) as f:
            agents = json.loads(f.read())
        return dealt(agents, int(self.options.get("max_concurrent", MAX_CONCURRENT)), folder) if agents else []

    def read(self, partition: Group) -> Iterator[tuple]:
        system, path = pyarrow.fs.FileSystem.from_uri(partition.kept)
        if system.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            rows = [(a, at.isoformat(), body, error) for a, at, body, error in fetched(partition.agents, partition.permits)]
            _keep(partition.kept, "".join(json.dumps(r) + "\n" for r in rows))
        with system.open_input_stream(path) as f:
            for line in f.read().decode().splitlines():
                agent, at, body, error = json.loads(line)
                yield agent, datetime.datetime.fromisoformat(at), body, error

    def commit(self, end: dict) -> None:
        """What batches up to this one have fetched is stored; their files go."""
        system, root = pyarrow.fs.FileSystem.from_uri(self.options["kept"])
        for info in system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.isdigit() and int(info.base_name) <= end["at"]:
                system.delete_dir(info.path)


def _keep(uri: str, content: str) -> None:
    """A file that is whole or not there; the first of several attempts counts."""
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(content.encode())
    if system.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        system.move(aside, path)
    else:
        system.delete_file(aside)


class ScrapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scrape"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _StreamReader(self.options)


def _options(agents: DataFrame) -> str:
    columns = ["id", "host", "port", "path", "scrape_interval_seconds", "timeout_seconds"]
    return json.dumps([r.asDict() for r in agents.where("enabled").select(*columns).collect()])  # the registry: one small row per agent


def scrape(spark: SparkSession, agents: DataFrame, max_concurrent: int = MAX_CONCURRENT) -> DataFrame:
    """Bodies of all enabled agents, fetched by executors whenever the result is read."""
    spark.dataSource.register(ScrapeSource)
    return spark.read.format("scrape").option("agents", _options(agents)).option("max_concurrent", max_concurrent).load()


def rounds(spark: SparkSession, registry: str, kept: str, stopped: str | None = None, max_concurrent: int = MAX_CONCURRENT) -> DataFrame:
    """Bodies of the agents that are due, as a stream with a round at each trigger."""
    spark.dataSource.register(ScrapeSource)
    reader = spark.readStream.format("scrape").option("registry", registry).option("kept", kept).option("max_concurrent", max_concurrent)
    return (reader.option("stopped", stopped) if stopped else reader).load()


def bodies_from_files(spark: SparkSession, path: str) -> DataFrame:
    """Bodies kept as whole files named by agent: replay without a network. A body's time is its file's."""
    agent = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(\.[^/.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(agent.alias("agent_id"), F.col("_metadata.file_modification_time").alias("scraped_at"), F.col("value").alias("body"), F.lit(None).cast("string").alias("error"))
