"""Tables on disk: the graph by project, the event log, kept outputs. Parquet, partitioned, replaced as wholes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_TABLES = ("files", "nodes", "edges", "refs")


def write_project(graph: dict[str, DataFrame], root: str) -> None:
    """Replaces the partitions of the projects that the tables hold; other projects stay as they are."""
    for name in GRAPH_TABLES:
        graph[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{root}/{name}")


def read_graph(spark: SparkSession, root: str, project_id: int | None = None) -> dict[str, DataFrame]:
    """The tables, of one project by partition pruning."""
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in GRAPH_TABLES}
    return tables if project_id is None else {k: v.filter(F.col("project_id") == project_id) for k, v in tables.items()}


def swap(df: DataFrame, path: str) -> None:
    """Replaces a table that the rows may come from: written beside it, then renamed into its place."""
    spark = df.sparkSession
    new, old = (f"{path}.{kind}-{uuid.uuid4().hex[:8]}" for kind in ("new", "old"))
    df.write.parquet(new)
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, jvm.Path(old))
    fs.rename(jvm.Path(new), target)
    fs.delete(jvm.Path(old), True)


def append_events(events: DataFrame, path: str) -> None:
    """Adds events, by day; columns that older files lack are null when read."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def captured(runs: DataFrame, limit: int = 10 << 20) -> DataFrame:
    """Runs whose outputs (binary stdout, stderr) are bounded and decoded, with what was cut: never a command run."""
    def text(c: str) -> Column:
        return F.make_valid_utf8(F.substring(F.col(c), 1, limit).cast("string"))

    size = {c: F.octet_length(F.coalesce(F.col(c), F.lit(b""))) for c in ("stdout", "stderr")}
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False)) if "timed_out" in runs.columns else F.lit(False)
    capture = F.struct(size["stdout"].cast("long").alias("stdout_bytes"), size["stderr"].cast("long").alias("stderr_bytes"), (size["stdout"] > limit).alias("stdout_truncated"), (size["stderr"] > limit).alias("stderr_truncated"), timed_out.alias("timed_out"), F.lit(limit).cast("long").alias("limit_bytes"))
    out = runs.select(*[c for c in runs.columns if c not in ("stdout", "stderr", "exit_code", "timed_out")], F.coalesce(text("stdout"), F.lit("")).alias("stdout"), F.coalesce(text("stderr"), F.lit("")).alias("stderr"), F.when(timed_out, 124).otherwise(F.col("exit_code")).alias("exit_code"), capture.alias("capture"))
    c = F.col("capture")
    return out.withColumn("raw_output_complete", ~(c["stdout_truncated"] | c["stderr_truncated"] | c["timed_out"]))
