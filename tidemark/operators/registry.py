"""The agents' registry: a log of commits, read through the latest version of each agent.

A commit is one file named by its number, which is created only if no one else has created it (compare and set). Whoever comes second reads the log again and
decides again: so of any number of writers that add one id, one succeeds and the others see a conflict. All changes of a commit are
seen together. A change is a full row with the operation (put, drop); dropping is a tombstone. compact() replaces all commits by one snapshot; a reader or writer beside it
sees the same agents. Samples are never touched: they outlive renames and deletions."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import AGENTS, AGENTS_LOG
from tidemark.sources.files import Files

#: How often a writer that others outrun decides anew before it gives up, and a reader that meets a compaction reads anew.
TRIES = 100


class Missing(LookupError):
    """No agent has that id (an HTTP layer says 404)."""


class Conflict(ValueError):
    """The id is taken (an HTTP layer says 400)."""


class Busy(RuntimeError):
    """Other writers outran this one each time."""


@dataclass
class Agent:
    id: str
    host: str
    port: int
    path: str = "/metrics"
    scrape_interval_seconds: int = 15
    enabled: bool = True
    timeout_seconds: int = 5
    last_scrape_at: datetime.datetime | None = None
    last_scrape_status: str | None = None
    created_at: datetime.datetime | None = None
    updated_at: datetime.datetime | None = None


def _line(agent: Agent, op: str, seq: int) -> str:
    """A change as a line of JSON; times in UTC."""
    fields = {k: v.astimezone(datetime.UTC).isoformat() if isinstance(v, datetime.datetime) else v for k, v in asdict(agent).items()}
    return json.dumps(fields | {"op": op, "seq": seq})


class Registry:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def _versions(self) -> list[str]:
        return [n for n in self.files.names(self.path) if n.endswith(".json") and not n.startswith("_")]

    @staticmethod
    def _number(name: str) -> int:
        return int(name.partition(".")[0])

    def _log(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(AGENTS_LOG).json([f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], AGENTS_LOG)

    def log(self) -> DataFrame:
        """All changes that are kept, in no order."""
        return self._log(self._versions())

    @staticmethod
    def _latest(log: DataFrame) -> DataFrame:
        last = log.groupBy("id").agg(F.max_by(F.struct(*AGENTS_LOG.fieldNames()), "seq").alias("v"))
        return last.where("v.op = 'put'").select("v.*")

    def agents(self) -> DataFrame:
        """The latest version of every agent that isn't dropped."""
        return self._latest(self.log()).select(*AGENTS.fieldNames())

    def _retried(self, act: Callable[[list[str]], object]) -> object:
        """act on the names of the present commits; again where a compaction took files away meanwhile."""
        for k in range(TRIES):
            names = self._versions()
            try:
                return act(names)
            except (AnalysisException, Py4JJavaError, OSError):
                if k == TRIES - 1 or self._versions() == names:
                    raise
        return None

    def _found(self, names: list[str], *ids: str) -> dict[str, Agent]:
        rows = self._latest(self._log(names).where(F.col("id").isin(*ids))).select(*AGENTS.fieldNames()).collect()
        return {r["id"]: Agent(**r.asDict()) for r in rows}

    def _commit(self, ids: tuple[str, ...], decide: Callable[[dict[str, Agent]], list[tuple[str, Agent]]]) -> None:
        """Changes that decide() makes of the agents of ids as they are, as the next commit; decided anew whenever someone else was faster."""

        def attempt(names: list[str]) -> bool:
            number = max(map(self._number, names), default=0) + 1
            changes = decide(self._found(names, *ids))
            # one commit's changes follow each other: their numbers share its own
            lines = [_line(a, op, (number << 20) + k) for k, (op, a) in enumerate(changes)]
            return self.files.create(f"{self.path}/{number:020d}.json", "\n".join(lines) + "\n")

        for _ in range(TRIES):
            if self._retried(attempt):
                return
        raise Busy(self.path)

    @staticmethod
    def _now() -> datetime.datetime:
        return datetime.datetime.now()

    def get(self, agent_id: str) -> Agent | None:
        return self._retried(lambda names: self._found(names, agent_id).get(agent_id))

    @staticmethod
    def _need(found: dict[str, Agent], agent_id: str) -> Agent:
        if agent_id not in found:
            raise Missing(agent_id)
        return found[agent_id]

    def seed(self) -> None:
        """The default agent, if there is none at all."""
        if self.agents().isEmpty():
            self.add(Agent("agent-1", "localhost", 9090))

    def add(self, agent: Agent) -> Agent:
        def decide(found: dict[str, Agent]) -> list[tuple[str, Agent]]:
            if agent.id in found:
                raise Conflict(agent.id)
            agent.created_at = agent.updated_at = self._now()
            return [("put", agent)]

        self._commit((agent.id,), decide)
        return agent

    def update(self, agent: Agent) -> Agent:
        """All fields anew, but for when it was created and its scrape history."""

        def decide(found: dict[str, Agent]) -> list[tuple[str, Agent]]:
            old = self._need(found, agent.id)
            agent.created_at, agent.updated_at = old.created_at, self._now()
            agent.last_scrape_at, agent.last_scrape_status = old.last_scrape_at, old.last_scrape_status
            return [("put", agent)]

        self._commit((agent.id,), decide)
        return agent

    def rename(self, agent_id: str, new_id: str) -> Agent:
        """The agent under another id, with its history; both changes are one commit."""
        made: list[Agent] = []

        def decide(found: dict[str, Agent]) -> list[tuple[str, Agent]]:
            old = self._need(found, agent_id)
            if new_id in found:
                raise Conflict(new_id)
            made[:] = [Agent(**(asdict(old) | {"id": new_id, "updated_at": self._now()}))]
            return [("drop", old), ("put", made[0])]

        self._commit((agent_id, new_id), decide)
        return made[0]

    def delete(self, agent_id: str, hard: bool = False) -> None:
        """Disabled, or dropped if hard."""
        if hard:
            self._commit((agent_id,), lambda found: [("drop", self._need(found, agent_id))])
        else:
            self.enable(agent_id, False)

    def enable(self, agent_id: str, enabled: bool) -> Agent:
        return self.patch(agent_id, enabled=enabled)

    def patch(self, agent_id: str, **fields: object) -> Agent:
        """Some fields anew; None keeps the old value."""
        made: list[Agent] = []

        def decide(found: dict[str, Agent]) -> list[tuple[str, Agent]]:
            old = self._need(found, agent_id)
            made[:] = [Agent(**(asdict(old) | {k: v for k, v in fields.items() if v is not None} | {"updated_at": self._now()}))]
            return [("put", made[0])]

        self._commit((agent_id,), decide)
        return made[0]

    def scraped(self, agent_id: str, at: datetime.datetime, status: str) -> Agent:
        return self.patch(agent_id, last_scrape_at=at, last_scrape_status=status)

    def compact(self) -> None:
        """All commits up to now replaced by a snapshot of the latest versions, which keep their numbers. The old files go in order: what is left of them never shows an agent without its tombstone."""

        def attempt(names: list[str]) -> list[str]:
            if names:
                number = max(map(self._number, names))
                rows = self._latest(self._log(names)).collect()  # one small row per agent
                lines = [_line(Agent(**{k: v for k, v in r.asDict().items() if k not in ("op", "seq")}), "put", r["seq"]) for r in rows]
                self.files.write(f"{self.path}/{number:020d}.snapshot.json", "\n".join(lines) + "\n")
            return names

        done = self._retried(attempt)
        snapshot = f"{self._number(done[-1]):020d}.snapshot.json" if done else None
        for name in done:
            if name != snapshot:
                self.files.delete(f"{self.path}/{name}")
