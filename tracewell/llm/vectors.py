"""Vectors for the searches: which rows take part, equal vectors as one, blocks of rows, blocks of queries against them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import written


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part: id and vector not null, all components finite.

    Without `zero`, vectors of zeros only, or of no components, take no part either.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(~odd)
    return rows if zero else rows.filter(F.exists("vector", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, nearest: int, name: str) -> DataFrame:
    """v (a number), vector, ids: one row for each distinct vector with its `nearest` + 1 smallest ids in order.

    The answers stay exact: a row with more than `nearest` equals of smaller ids can't be among the `nearest` rows
    of any query, itself left out. Each task sends on so many rows of a vector at most, so one that a third of all
    rows share meets nowhere.
    """
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= nearest + 1)
    found = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return written(found.select(F.monotonically_increasing_id().alias("v"), "vector", "ids"), name)


def merged(one: DataFrame, other: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the input. It is never a broadcast: the planner's estimate is of packed files, and
    vectors take several times that in the driver."""
    return one.hint("merge").join(other.hint("merge"), by, how)


def matrix(col: pa.Array, width: int, kind: type) -> np.ndarray:
    """The vectors of a column as rows; shorter ones count as padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def packed(rows: DataFrame, width: int, most: int, kind: str) -> DataFrame:
    """Blocks of up to `most` rows of v, vector, extra: block, keys, extras, matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            keys, extras, all_rows = (np.concatenate([h[i] for h in held]) for i in range(3))
            return pa.record_batch([pa.array([part << 24 | made], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, extras, all_rows))], ["block", "keys", "extras", "matrix"])

        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, most - count)
                held.append((np.asarray(some.column(0)), np.asarray(some.column(2)), matrix(some.column(1), width, np.dtype(kind))))
                count += some.num_rows
                at += some.num_rows
                if count == most:
                    yield block()
                    held, count, made = [], 0, made + 1
        if count:
            yield block()

    return rows.mapInArrow(run, "block long, keys binary, extras binary, matrix binary")


def block_pairs(queries: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """Every block of the query set beside every block of rows, by an exchange on groups of blocks.

    The `count` blocks of rows are dealt into groups, as many as there are shuffle partitions at most; each query
    block goes to each group once. Columns of the query blocks get the prefix q_. Neither side is ever broadcast: the
    planner knows neither a block's bytes nor that the query set goes to every group.
    """
    groups = max(1, min(count, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn("q_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return queries.hint("merge").join(blocks.hint("merge"), F.col("group") == F.col("q_group")).drop("q_group", "group")


def each_pair(pairs: DataFrame, f: Callable[[dict], pa.RecordBatch], schema: str, columns: list[str]) -> DataFrame:
    """f of each row of pairs, one at a time: a batch holds few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = f({c: batch.column(i)[k].as_buffer() if pa.types.is_binary(batch.schema.types[i]) else batch.column(i)[k].as_py() for i, c in enumerate(columns)})
                if out.num_rows:
                    yield out

    return pairs.select(*columns).mapInArrow(run, schema)


def width_of(vecs: DataFrame) -> int:
    """Components of the longest vector."""
    return vecs.agg(F.max(F.size("vector"))).first()[0] or 0


def answers(found: DataFrame, vecs: DataFrame, rows: DataFrame, is_query: Column, nearest: int) -> DataFrame:
    """query_id, rank, vec_id, score from found (v of the query's vector, c of a candidate's, score).

    Equal query vectors were searched once; every query row gets their candidates' ids, its own left out, best
    score first, ties to the smaller id.
    """
    best = merged(found, vecs.select(F.col("v").alias("c"), "ids"), "c").select("v", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("place", place).filter(F.col("place") <= nearest + 1)
    best = best.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    of_vector = merged(best, vecs.select("v", F.col("vector")), "v").select("vector", "best")
    asked = merged(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector"), of_vector, "vector")
    left = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    out = asked.select("query_id", F.posexplode(left).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
