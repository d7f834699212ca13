"""Worker statistics as they happen: a keyed state with a timer for each agent, over a stream of the runs' log.

A trigger costs what its new runs cost, however long the log is. The state is the table: it is read from the query's checkpoint. Runs of one agent
and time are one run, so a round that was stored again changes nothing if it comes within REMEMBERED of the first time.

Each call to the state is a round trip from Python to the JVM, so an agent's runs of a trigger are taken together: their times are remembered as one
entry, and what is remembered is only looked at where a run is no later than the last one known, for one that is later can't have been stored before."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: How long runs are known by their time, and after how long without a run a worker is stale, in milliseconds.
REMEMBERED, STALE = 24 * 3600 * 1000, 5 * 60 * 1000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds here, for a state gives back times in another form than rows do.
_STATE = "total_runs long, successful_runs long, failed_runs long, last_run_us long, last_end_us long, last_error string, last_run_ms long, timer_ms long"
#: Times of runs in one entry of what is remembered, at most.
_ENTRY = 4096
_OUT = "agent_id string, total_runs long, successful_runs long, failed_runs long, last_run_us long, last_error string, last_run_ms long, stale boolean"


class Worker(StatefulProcessor):
    """Counts and the last run of an agent. Rows: agent_id, started_us, finished_us, error."""

    def __init__(self, stale_ms: int = STALE) -> None:
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stats = handle.getValueState("stats", _STATE)
        self.seen = handle.getListState("seen", "starts array<long>", REMEMBERED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        total, good, bad, last, end, error, ms, timer = self.stats.get() or (0, 0, 0, None, None, None, None, None)
        before, known, new = last, None, {}
        for r in rows:
            at = r.started_us
            if at in new:
                continue
            if total and (before is None or at is None or at <= before):
                known = {x for (starts,) in self.seen.get() for x in starts} if known is None else known
                if at in known:
                    continue
            new[at] = r
        for r in new.values():
            failed = r.error is not None
            total, good, bad = total + 1, good + (not failed), bad + failed
            if last is None or (r.started_us is not None and (r.started_us, r.finished_us or 0) >= (last, end or 0)):
                took = None if failed or r.finished_us is None or r.started_us is None else int((r.finished_us - r.started_us) / 1000)
                last, end, error, ms = r.started_us, r.finished_us, r.error, took
        starts = list(new)
        if starts:
            self.seen.appendList([(starts[i : i + _ENTRY],) for i in range(0, len(starts), _ENTRY)])
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.stale_ms
        self.handle.registerTimer(timer)
        self.stats.update((total, good, bad, last, end, error, ms, timer))
        yield Row(agent_id=key[0], total_runs=total, successful_runs=good, failed_runs=bad, last_run_us=last, last_error=error, last_run_ms=ms, stale=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        total, good, bad, last, end, error, ms, _ = self.stats.get()
        self.stats.update((total, good, bad, last, end, error, ms, None))
        yield Row(agent_id=key[0], total_runs=total, successful_runs=good, failed_runs=bad, last_run_us=last, last_error=error, last_run_ms=ms, stale=True)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store. Queries that start from now on use it, and keep it in their checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def watched(runs: DataFrame, stale_ms: int = STALE) -> DataFrame:
    """A stream of runs as a stream of statistics: a row for each agent with new runs, and one with stale = true when an agent has had none for stale_ms."""
    use_rocksdb(runs.sparkSession)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = runs.select("agent_id", us("started_at").alias("started_us"), us("finished_at").alias("finished_us"), "error")
    out = rows.groupBy("agent_id").transformWithState(Worker(stale_ms), _OUT, "Update", "ProcessingTime")
    return out.withColumn("last_run_us", F.timestamp_micros("last_run_us")).withColumnRenamed("last_run_us", "last_run_at")


def start(runs: DataFrame, checkpoint: str, every: str | None = "30 seconds", stale_ms: int = STALE) -> StreamingQuery:
    """Keep the statistics of a stream of runs; every=None takes what is there in one batch and ends (a state with timers always has another one to run)."""
    writer = watched(runs, stale_ms).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(once=True)).start()


def stats(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state holds after the last trigger that ended: the columns of operators.runs.worker_stats."""
    state = spark.read.format("statestore").option("stateVarName", "stats").load(checkpoint)
    value = lambda c: F.col(f"value.{c}").alias(c)
    return state.select("key.agent_id", *map(value, ("total_runs", "successful_runs", "failed_runs")), F.timestamp_micros("value.last_run_us").alias("last_run_at"), value("last_error"), value("last_run_ms"))
