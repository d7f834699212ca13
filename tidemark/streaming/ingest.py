"""Ingest: bodies to samples, samples to the store and the log of runs, as batches or as a stream.

A round of bodies has a name of its stream and batch, and so have the folders of its samples and runs: a round that is stored again replaces
itself, and rounds of other streams, or of a stream with another checkpoint, are never in its way. Samples keep whatever time they carry, and nothing is dropped as
late; a watermark is an opt-in. A sample without a time gets its body's, one for all its lines."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.buckets import parse_width, time_bucket, window_offset
from tidemark.operators.runs import status
from tidemark.schema import METRICS, ROUNDS, SCRAPE_BODIES, SCRAPE_RUNS
from tidemark.session import shared_dir
from tidemark.sources.exposition import parse
from tidemark.sources.files import Files
from tidemark.sources.series import SeriesStore
from tidemark.sources.store import replaced, write_metrics


def samples(bodies: DataFrame) -> DataFrame:
    """bodies: agent_id, scraped_at, body. Samples as rows of the metrics table; an id is a hash of a sample's body (agent and time) and place in it, the same however often and in whatever partitions it is computed."""
    rows = parse(bodies.select("agent_id", "scraped_at", "body"))
    at = F.coalesce("timestamp", "scraped_at")
    ident = F.xxhash64("agent_id", "scraped_at", "line", "name", "value", at, F.array_sort(F.map_entries("tags")).cast("string"))
    return rows.select(ident.alias("id"), "name", "value", at.alias("timestamp"), "agent_id", "tags", "scraped_at")


def runs(bodies: DataFrame, counts: DataFrame) -> DataFrame:
    """The log's row of each body: how many samples, status, error. counts: agent_id, scraped_at, n_samples."""
    rows = bodies.select("agent_id", "scraped_at", "error").join(counts, ["agent_id", "scraped_at"], "left")
    n = F.coalesce("n_samples", F.lit(0))
    return rows.select("agent_id", F.col("scraped_at").alias("started_at"), F.current_timestamp().alias("finished_at"), n.alias("n_samples"), status(n, F.col("error")).alias("status"), "error")


def _of_round(spark: SparkSession, files: Files, path: str, schema: StructType, name: str) -> DataFrame:
    """What a table holds of one round: its folders alone are listed."""
    there = files.glob(f"{path}/date=*/round={name}")
    return spark.read.schema(schema).option("basePath", path).parquet(*there) if there else spark.createDataFrame([], schema)


def store_batch(bodies: DataFrame, metrics_path: str, runs_path: str, stream: str | None = None, batch: int = 0, series: SeriesStore | None = None) -> dict[str, int]:
    """One round: its samples, then the runs that tell of them, then a row of its own figures (table `{runs_path}_rounds`), which are returned too.

    stream and batch name the round; what was stored of it before is replaced, so a batch that broke off anywhere and is replayed is there once. Its bodies must be the same
    then, as a replayable source gives them. A series store is given the round's samples too, under the same name. Without a name the bodies are those of a source that can't repeat them: they are written down first. Bodies are parsed once: how many samples each gave is counted in the files just written."""
    spark, began = bodies.sparkSession, time.time()
    once = None
    if stream is None:
        stream, once = f"own-{uuid.uuid4().hex}", f"{shared_dir(spark)}/bodies-{uuid.uuid4().hex}"
        bodies.write.parquet(once)
        bodies = spark.read.schema(SCRAPE_BODIES).parquet(once)
    name, files = f"{stream}-{batch}", Files(spark, metrics_path)
    write_metrics(samples(bodies), metrics_path, name)
    there = _of_round(spark, files, metrics_path, METRICS, name)
    if series is not None:
        series.add(there.select("id", "name", "value", "timestamp", "agent_id", "tags"), name)
    counts = there.groupBy("agent_id", "scraped_at").agg(F.count("*").alias("n_samples"))
    replaced(runs(bodies, counts).withColumns({"date": F.to_date("started_at"), "round": F.lit(name)}), runs_path)
    seen = _of_round(spark, files, runs_path, SCRAPE_RUNS, name).agg(F.coalesce(F.sum("n_samples"), F.lit(0)).alias("samples"), F.count("*").alias("agents"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
    figures = {**seen.asDict(), "ms": int((time.time() - began) * 1000)}
    if figures["agents"]:  # rounds in which no one was due aren't told of
        _told(spark, runs_path, stream, batch, name, began, figures)
    if once:
        Files(spark, once).delete(once)
    return figures


def _told(spark: SparkSession, runs_path: str, stream: str, batch: int, name: str, began: float, figures: dict[str, int]) -> None:
    row = spark.range(1).select(F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch"), *(F.lit(figures[c]).cast("long").alias(c) for c in ("samples", "agents", "failed")), F.timestamp_millis(F.lit(int(began * 1000))).alias("started_at"), F.lit(figures["ms"]).cast("long").alias("ms"), F.lit(name).alias("round"))
    replaced(row, f"{runs_path}_rounds", "round")


def rounds(spark: SparkSession, runs_path: str) -> DataFrame:
    """Figures of the rounds that were stored: stream, batch, samples, agents, failed, started_at, ms."""
    path = f"{runs_path}_rounds"
    return (spark.read.schema(ROUNDS).parquet(path) if Files(spark, path).exists(path) else spark.createDataFrame([], ROUNDS)).drop("round")


def start(bodies: DataFrame, metrics_path: str, runs_path: str, checkpoint: str, every: str | None = "30 seconds", series: SeriesStore | None = None) -> StreamingQuery:
    """Store a stream of bodies, a round per trigger, under the stream's own id, which lives in its checkpoint; every=None takes what is there and ends."""
    return each_round(bodies, lambda batch, k, stream: store_batch(batch, metrics_path, runs_path, stream, k, series), checkpoint, every)


def each_round(stream: DataFrame, act: Callable[[DataFrame, int, str], object], checkpoint: str, every: str | None) -> StreamingQuery:
    """act on each batch of a stream, its number and the stream's id."""
    started, query = threading.Event(), []

    def on_batch(batch: DataFrame, k: int) -> None:
        started.wait()
        act(batch, k, query[0].id)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    query.append((writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start())
    started.set()
    return query[0]


def aggregated(metrics: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """avg, max, min and count per bucket over a stream. Without a watermark no sample is late and the output is complete or update; with one, closed buckets can be appended.
    Buckets of months and years have no watermark here, as windows have a fixed length: see streaming.calendar for theirs."""
    if watermark:
        metrics = metrics.withWatermark("timestamp", watermark)
        us, _ = parse_width(width)
        window = F.window("timestamp", f"{us} microseconds", f"{us} microseconds", window_offset(width))
        grouped, bucket = metrics.groupBy(window.alias("w")), F.col("w.start")
    else:
        grouped, bucket = metrics.groupBy(time_bucket(width, F.col("timestamp")).alias("w")), F.col("w")
    v = F.col("value")
    return grouped.agg(F.avg(v).alias("avg_value"), F.max(v).alias("max_value"), F.min(v).alias("min_value"), F.count("*").alias("sample_count")).select(bucket.alias("bucket"), "avg_value", "max_value", "min_value", "sample_count")


def deduplicated(metrics: DataFrame, within: str) -> DataFrame:
    """Opt-in: of samples of one series and time, seen within a watermark, the first alone."""
    return metrics.withWatermark("timestamp", within).withColumn("series", F.xxhash64("name", "agent_id", F.array_sort(F.map_entries("tags")).cast("string"))).dropDuplicatesWithinWatermark(["series", "timestamp"]).drop("series")


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its final table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
