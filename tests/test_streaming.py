"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from tracewell.streaming import sinks

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_event_sink(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("event_id", F.col("event_id").cast("string"))
    q = sinks.event_sink(stream(spark, tmp_path, events.unionByName(events)), str(tmp_path / "out"), str(tmp_path / "cp"), every=None, late="60 days")
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == events.count() == out.select("event_id").distinct().count()


def test_visits(spark, tmp_path):
    rows = [("c", "w", "f", "h", "2024-01-01 00:01:00", False, False), ("c", "w", "f", "h", "2024-01-01 00:02:00", False, False), ("c", "w", "f", None, "2024-01-01 00:03:00", False, True), ("c", "w", "f", "h", "2024-01-01 00:04:00", False, False), ("c", "w", "f", "x", "2024-01-01 00:05:00", True, False)]
    df = spark.createDataFrame(rows, "connection_id string, cw_id string, path string, content_hash string, ts string, is_excerpt boolean, reset boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    q = sinks.visits(stream(spark, tmp_path, df)).writeStream.format("memory").queryName("visits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["unchanged"] for r in spark.table("visits").orderBy("ts").collect()] == [False, True, False]


def test_sync_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", "create", 1), ("a", "remove", 2), ("b", "modify", 1), ("c", "access", 1)], "path string, kind string, ts long")
    seen = []
    q = sinks.sync_stream(stream(spark, tmp_path, df), lambda rows, n: seen.extend((r["path"], r["kind"]) for r in rows.collect()), str(tmp_path / "cp"), every=None)
    q.awaitTermination(120)
    assert sorted(seen) == [("a", "remove"), ("b", "modify")]
