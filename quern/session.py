"""SparkSession factory used by tests, the bench and the entry module."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cores: int | str | None = None, app: str = "quern") -> SparkSession:
    """A local session with AQE on, UTC time and Arrow transfer.

    On a cluster the caller brings a session of their own; no operator here depends on these
    settings for right results.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
