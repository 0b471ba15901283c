"""Session factory and the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that the semantics need; cluster sizing is left to the cluster.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Bytes of one Arrow batch at most: rows of long texts would otherwise come to
#: Python ten thousand at a time.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Python workers give freed memory back instead of keeping an arena a thread.
WORKER_ENVIRONMENT = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def session(name: str = "terrane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use ``__`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SEMANTICS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return share_code(builder.getOrCreate())


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed there,
    and bound what they hold at a time, unless the cluster has its own settings."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in WORKER_ENVIRONMENT.items():
        env.setdefault(name, value)
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(16 << 20))
    return spark
