"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracewell-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; a cluster,
    whose machines would each write to their own disk, an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = _own_folder()
    return f"{top.rstrip('/')}/tracewell/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """The same rows, written and read again: what made them isn't planned or run a second time."""
    folder = work_folder(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
