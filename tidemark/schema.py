"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
TAGS = T.MapType(_S, _S)

AGENTS = _struct(
    ("id", _S, False), ("host", _S, False), ("port", _I, False), ("path", _S, False), ("scrape_interval_seconds", _L, False), ("enabled", _B, False),
    ("timeout_seconds", _I, True), ("last_scrape_at", _TS, True), ("last_scrape_status", _S, True), ("created_at", _TS, True), ("updated_at", _TS, True),
)
AGENTS_LOG = T.StructType([*AGENTS.fields, T.StructField("op", _S), T.StructField("seq", _L)])
METRICS = _struct(("id", _L, False), ("name", _S, False), ("value", _D, False), ("timestamp", _TS, False), ("agent_id", _S, False), ("tags", TAGS, True), ("scraped_at", _TS, True), ("date", T.DateType(), True), ("round", _S, True))
#: A round of scraping as it was stored: which stream and batch, and figures of the run itself.
ROUNDS = _struct(("stream", _S, False), ("batch", _L, False), ("samples", _L, False), ("agents", _L, False), ("failed", _L, False), ("started_at", _TS, False), ("ms", _L, False), ("round", _S, True))
SAMPLES = _struct(("name", _S, False), ("value", _D, False), ("timestamp", _TS, True), ("tags", TAGS, True))
SCRAPE_BODIES = _struct(("agent_id", _S, False), ("scraped_at", _TS, False), ("body", _S, True), ("error", _S, True))
SCRAPE_RUNS = _struct(("agent_id", _S, False), ("started_at", _TS, False), ("finished_at", _TS, True), ("n_samples", _L, True), ("status", _S, True), ("error", _S, True), ("date", T.DateType(), True), ("round", _S, True))
