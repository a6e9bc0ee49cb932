"""Session state from logs of what happened: repeated reads, resets, watches, kept outputs, events once each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.work import stored

#: Hours and bytes for which outputs are kept.
KEEP_HOURS, KEEP_BYTES = 24, 256 << 20


def running_sum(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The rows with `name`: the sum of a value over the rows of equal keys up to this one. A null value counts as 0.

    The rows stand by keys and order in range partitions; each partition's totals (a row for each partition and key) give
    what comes before it, so no key however frequent meets in one task.
    """
    valued = rows.withColumn(name, F.coalesce(value, F.lit(0)))
    placed = stored(valued.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "running-parts")
    totals = placed.groupBy(*keys, "__part").agg(F.sum(name).alias("total"))
    before = F.sum("total").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__part").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn(name, F.sum(name).over(inside))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], F.col("__part") == F.col("__at"))
    return placed.join(totals, same).withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name)


def unchanged_reads(reads: DataFrame, resets: DataFrame) -> DataFrame:
    """The reads with `unchanged`: a full read whose content is that of the last full read of the file by the same
    connection and window since its last reset. Excerpts neither look at what was read nor count as read.

    A reset without connection is for the window in every connection.
    """
    keys = ["connection_id", "cw_id"]
    marks = resets.select("connection_id", "cw_id", "ts", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("content_hash"), F.lit(False).alias("is_excerpt"), F.lit(1).alias("reset"))
    wide = marks.filter("connection_id is null").drop("connection_id").join(reads.select(*keys).distinct(), "cw_id").select(marks.columns)
    log = reads.select("connection_id", "cw_id", "ts", "path", "content_hash", "is_excerpt", F.lit(0).alias("reset")).unionByName(marks.filter("connection_id is not null")).unionByName(wide)
    full = running_sum(log, keys, [F.col("ts"), F.desc("reset")], F.col("reset"), "epoch").filter("reset = 0")
    last = F.last(F.when(~F.col("is_excerpt"), F.col("content_hash")), ignorenulls=True)
    before = last.over(Window.partitionBy(*keys, "epoch", "path").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    return full.select(*keys, "ts", "path", "content_hash", "is_excerpt", F.coalesce(~F.col("is_excerpt") & (before == F.col("content_hash")), F.lit(False)).alias("unchanged"))


def visit_cache(reads: DataFrame, expire_before: Column | None = None) -> DataFrame:
    """The latest full read of each file by connection and window, not older than `expire_before`."""
    full = reads.filter(~F.col("is_excerpt"))
    cache = full.groupBy("connection_id", "cw_id", "path").agg(F.max_by(F.struct("content_hash", "token_count", F.col("ts").alias("last_visit")), "ts").alias("entry")).select("connection_id", "cw_id", "path", "entry.*")
    return cache if expire_before is None else cache.filter(F.col("last_visit") >= expire_before)


def without_window(cache: DataFrame, cw_id: str, connection_id: str | None = None) -> DataFrame:
    """The cache without a window, of one connection or of all."""
    match = F.col("cw_id") == cw_id
    return cache.filter(~(match if connection_id is None else match & (F.col("connection_id") == connection_id)))


def watch_registry(log: DataFrame) -> DataFrame:
    """root, ref_count, consumers (client:session, sorted) of the roots that someone watches, from watch, unwatch and
    close events; close ends all watches of its session."""
    opened = log.filter(F.col("action").isin("watch", "unwatch"))
    pairs = opened.select("root", "client", "session_id").distinct()
    closed = log.filter("action = 'close'").select("client", "session_id", "ts").join(pairs, ["client", "session_id"])
    every = opened.select("root", "client", "session_id", "ts", (F.col("action") == "watch").alias("on")).unionByName(closed.select("root", "client", "session_id", "ts", F.lit(False).alias("on")))
    latest = every.groupBy("root", "client", "session_id").agg(F.max_by("on", F.struct("ts", ~F.col("on"))).alias("on")).filter("on")
    return latest.groupBy("root").agg(F.count("*").alias("ref_count"), F.sort_array(F.collect_list(F.concat_ws(":", "client", "session_id"))).alias("consumers"))


def status_lines(registry: DataFrame) -> DataFrame:
    """root and one line of text about it."""
    return registry.select("root", F.format_string("%s: %d consumers [%s]", "root", "ref_count", F.array_join("consumers", ", ")).alias("line"))


def retained(spool: DataFrame, now: Column, hours: int = KEEP_HOURS, most: int = KEEP_BYTES, group: str | None = None) -> DataFrame:
    """Entries young enough, newest first as long as they fit together, in each `group` or, without one, in all; of equal
    times the larger run id is newer."""
    key = F.lit(0) if group is None else F.col(group)
    young = spool.filter(F.col("mtime") >= now - F.expr(f"INTERVAL {hours} HOURS")).withColumn("__group", key)
    newer = running_sum(young, ["__group"], [F.desc("mtime"), F.desc("run_id")], F.col("total_bytes"), "newer_bytes")
    return newer.filter(F.col("newer_bytes") <= most).drop("__group")


def newest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n last rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def readable(spool: DataFrame, run_id: str, session_id: str, client: str | None) -> DataFrame:
    """The entry of a run for its owner: same session, same client as far as both are known."""
    same = F.lit(True) if client is None else F.coalesce(F.col("client") == client, F.lit(True))
    return spool.filter((F.col("run_id") == run_id) & (F.col("session_id") == session_id) & same)


def once(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Events without repeated ids and without those already stored; a missing id is filled."""
    named = events.withColumn("event_id", F.coalesce("event_id", F.uuid()))
    new = named.dropDuplicates(["event_id"])
    return new if stored is None else new.join(stored.select("event_id"), "event_id", "left_anti")


def epochs(events: DataFrame, key: str, ts: str, is_reset: Column) -> DataFrame:
    """With `epoch`: resets of the key so far, the row's own included."""
    return running_sum(events, [key], [F.col(ts), F.col("event_id")], is_reset.cast("int"), "epoch")
