"""Spark session factory: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tracewell", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from spark-submit."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
