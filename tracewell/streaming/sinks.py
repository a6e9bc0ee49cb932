"""Streams: events stored once each, files synchronised as they change, visits as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import sys
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# workers get this module's functions with the task: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def event_sink(events: DataFrame, path: str, checkpoint: str, every: str | None = "100 milliseconds", late: str = "1 hour") -> StreamingQuery:
    """Appends a stream of events to Parquet, an event id once. Without `every` it takes what is there and ends."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("event_id", F.coalesce(F.col("event_id").cast("string"), F.expr("uuid()"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    writer = once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sync_stream(changes: DataFrame, apply, checkpoint: str, every: str | None = "700 milliseconds") -> StreamingQuery:
    """Calls apply(batch, batch_id) with the latest change of each path of a micro-batch; nothing between two batches is lost."""

    def batch(rows: DataFrame, number: int) -> None:
        kinds = rows.filter(F.col("kind").isin("create", "modify", "remove"))
        latest = kinds.groupBy("path").agg(F.max_by("kind", "ts").alias("kind"), F.max("ts").alias("ts"))
        apply(latest, number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


VISIT = "connection_id string, cw_id string, path string, content_hash string, ts timestamp, unchanged boolean"


def visits(reads: DataFrame) -> DataFrame:
    """Streaming form of the repeated-read decision: full reads with `unchanged`, state by connection, window and path.

    Resets come in the same stream as rows with `reset`: they must carry the path's key, one row for each path.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in batches:
            out = []
            for r in rows.sort_values("ts").itertuples(index=False):
                if r.reset:
                    last = None
                elif not r.is_excerpt:
                    out.append((*key, r.content_hash, r.ts, last == r.content_hash))
                    last = r.content_hash
            yield pd.DataFrame(out, columns=["connection_id", "cw_id", "path", "content_hash", "ts", "unchanged"])
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))

    return reads.groupBy("connection_id", "cw_id", "path").applyInPandasWithState(run, VISIT, "content_hash string", "append", GroupStateTimeout.NoTimeout)


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """An extension: calls of each tool by day, with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "tool").agg(F.count("*").alias("calls")).select(F.col("day.start").alias("day"), "tool", "calls")
