"""Session defaults."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "tidemark", **more: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use __ for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders made by this process, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the one that driver and executors share (spark.checkpoint.dir). One of our own is made only where none is named and the master is local (tests)."""
    app, named = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = _OWN.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        _OWN[app] = named
    return f"{named.rstrip('/')}/tidemark-{app}"
