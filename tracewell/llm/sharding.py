"""Contiguous shards of nearly equal bytes, by prefix sums over partition totals. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import written

#: Bytes that a document counts for besides its text.
OVERHEAD = 8


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard for every row, contiguous in the order of ids, cut at equal shares of all bytes.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus OVERHEAD), text_crc32, shard, slot (from 0 in
    each shard). The text never moves: id, size and checksum go through one range exchange; each partition's totals
    (a row for each partition) give the offsets that turn sums inside a partition into global ones. A row goes to
    the shard in whose share its middle byte lies, so a shard is off by at most one row at either end.

    Nulls: a null id sorts first, a null text has size OVERHEAD and the checksum of the empty text. Rows with equal
    ids stand by checksum and size; wholly equal rows are interchangeable. An empty table gives no rows. Other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32")), "shard-sizes")
    order = ["doc_id", "text_crc32", "size"]
    placed = written(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-parts")

    # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    offsets = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"))
    whole = placed.agg(F.sum("size").alias("all_bytes"))

    inside = Window.partitionBy("part").orderBy(*order)
    summed = placed.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})
    summed = summed.join(F.broadcast(offsets), "part").join(F.broadcast(whole))
    cut = summed.select(
        *order,
        F.least(F.lit(shards - 1), F.expr(f"int(({shards} * (2 * (bytes_before + upto) - size)) div (2 * all_bytes))")).alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    )
    cut = written(cut, "shard-cut")
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first_place"))  # a row for each shard
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of documents below path/shard=N. Ids must be unique and not null here."""
    at = byte_shards(docs, shards, id_col, text_col).select(F.col("doc_id").alias("__id"), "shard", "slot")
    full = docs.join(at, F.col(id_col) == F.col("__id")).drop("__id")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
