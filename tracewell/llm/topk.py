"""Exact top-k by inner product: the three-phase uniform threshold algorithm over lists of partial scores.

A vector's components fall into LISTS lists; a score is the sum of its partial scores, one in each list. Rows lie in
blocks; a task has a block of queries and a block of rows with all their lists at hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import bounded_arrow, written
from tracewell.llm.vectors import answers, block_pairs, distinct_vectors, each_pair, merged, packed, usable, width_of

LISTS = 2
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
#: The cutoff of a query that has seen too few candidates: everything is sent.
LOWEST = -(1 << 63)
#: Pairs whose scores are resolved at a time.
RESOLVED = 1 << 18
#: Up to this sum of magnitudes of products a double holds every partial score.
EXACT = 2.0**53


class Pair:
    """A block of queries beside a block of rows: partial scores by list, and whole scores of single pairs.

    Partial scores are doubles, each within `slack` of the true one: exact, with slack 0, while doubles hold every
    integer up to the sum of the products' magnitudes.
    """

    def __init__(self, pair: dict):
        self.q_keys, self.keys = np.frombuffer(pair["q_keys"], "<i8"), np.frombuffer(pair["keys"], "<i8")
        self.extras = np.frombuffer(pair["extras"], "<i8")
        self.a, self.b = np.frombuffer(pair["q_matrix"], "<i8").reshape(len(self.q_keys), -1), np.frombuffer(pair["matrix"], "<i8").reshape(len(self.keys), -1)
        wide_a, wide_b = self.a.astype(np.float64), self.b.astype(np.float64)
        width = self.a.shape[1]
        self.most = float(np.abs(wide_a).max(initial=0)) * float(np.abs(wide_b).max(initial=0)) * width
        self.slack = 0.0 if self.most < EXACT else self.most * (width + 2) * 2.0**-50
        cuts = [width * k // LISTS for k in range(LISTS + 1)]
        self.partials = [wide_a[:, x:y] @ wide_b[:, x:y].T for x, y in zip(cuts, cuts[1:], strict=False)]

    def scores(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The integer scores of these pairs; one beyond 64 bits is the nearest 64-bit integer."""
        near = sum(p[q, c] for p in self.partials)
        if not self.slack:
            return near.astype(np.int64)
        out = np.empty(len(q), np.int64)
        for at in range(0, len(q), RESOLVED):
            x, y = q[at : at + RESOLVED], c[at : at + RESOLVED]
            out[at : at + RESOLVED] = np.einsum("ij,ij->i", self.a[x].view(np.uint64), self.b[y].view(np.uint64)).view(np.int64)  # right if it fits
        edge = 2.0**63 - LISTS * self.slack
        for k in np.flatnonzero(np.abs(near) >= edge).tolist():
            whole = sum(x * y for x, y in zip(self.a[q[k]].tolist(), self.b[c[k]].tolist(), strict=True))
            out[k] = max(-(1 << 63), min((1 << 63) - 1, whole))
        return out

    def best(self, q: np.ndarray, c: np.ndarray, k: int) -> pa.RecordBatch:
        """Of these pairs each query's k best whole scores, ties by the rows' extras."""
        scores = self.scores(q, c)
        order = np.lexsort((self.extras[c], -scores.astype(object) if len(scores) and scores.min() == LOWEST else -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.record_batch([pa.array(self.q_keys[q[keep]]), pa.array(self.keys[c[keep]]), pa.array(self.extras[c[keep]]), pa.array(scores[keep])], ["v", "c", "least", "score"])


def _heads(k: int):
    """Phase one: each list's k best partial scores of each query; of their rows the k best whole scores."""

    def run(raw: dict) -> pa.RecordBatch:
        pair = Pair(raw)
        take = min(k, len(pair.keys))
        chosen = np.zeros(pair.partials[0].shape, bool)
        for partial in pair.partials:
            np.put_along_axis(chosen, np.argpartition(-partial, take - 1, axis=1)[:, :take], True, axis=1)
        return pair.best(*np.nonzero(chosen), k)

    return run


def _above(k: int):
    """Phases two and three: the rows with a partial score of cutoff / LISTS or more in some list, their whole scores
    resolved; those of the cutoff or more go on, k of each query at most."""

    def run(raw: dict) -> pa.RecordBatch:
        pair, cutoff = Pair(raw), np.frombuffer(raw["q_extras"], "<i8")
        # a saturated cutoff may stand for any larger or smaller score: nothing is held back by the lower one
        need = np.where(cutoff == LOWEST, -np.inf, cutoff.astype(np.float64) * (1 - 2.0**-52 * np.sign(cutoff))) / LISTS - pair.slack
        enough = np.zeros(pair.partials[0].shape, bool)
        for partial in pair.partials:
            enough |= partial >= need[:, None]
        out = pair.best(*np.nonzero(enough), k)
        by_key = dict(zip(pair.q_keys.tolist(), cutoff.tolist(), strict=True))
        at = np.array([by_key[v] for v in out.column(0).to_pylist()], np.int64)
        return out.filter(pa.array(np.asarray(out.column(3)) >= at))

    return run


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best whole scores of each query."""
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "least"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def exact_top_k(df: DataFrame, is_query: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k rows of highest integer inner product for each query row: query_id, rank, vec_id, score (long).

    Components become floor(scale * x). `is_query` is a condition on vec_id. Phase one: in each block of rows each list
    gives its k + 1 best partial scores of each query; the (k + 1)-th best whole score of all these rows is a safe
    cutoff t. Phase two: a row that scores t or more has t / LISTS or more in some list, so the cutoffs go to all
    blocks, whose lists collect such entries. Phase three: their whole scores are resolved where the block is at hand;
    only rows of t or more, k + 1 for each query and block at most, go on to the last ranking, ties to the smaller
    vec_id. What a task holds is bounded by a block of queries and one of rows. Equal vectors are searched once.

    Components and scores are exact integers; one beyond 64 bits counts as the nearest 64-bit integer (a score after
    its whole sum is known).
    Nulls: rows with a null id or vector, or a component that is null or not finite, take no part; a shorter vector
    counts as padded with zeros. Rows with equal ids are rows of their own; a query leaves out the rows with its id.
    With fewer candidates than k all are given. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    bounded_arrow(spark)
    rows = usable(df, id_col, vector_col, zero=True)
    rows = written(rows.select("vec_id", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("vector")), "topk-rows")
    vecs = distinct_vectors(rows, k, "topk-vectors")
    width = max(width_of(vecs), LISTS)
    asked = written(merged(rows.filter(is_query).select("vector").distinct(), vecs, "vector").select("v", "vector"), "topk-queries")
    blocks = written(packed(vecs.select("v", "vector", F.col("ids")[0].alias("extra")), width, block_rows, "<i8"), "topk-blocks")
    count, groups = blocks.count(), 1 + asked.count() // block_queries
    columns, schema = ["q_keys", "q_matrix", "q_extras", "keys", "extras", "matrix"], "v long, c long, least long, score long"

    queries = packed(asked.select("v", "vector", F.lit(0).cast("long").alias("extra")).coalesce(groups), width, block_queries, "<i8")
    heads = each_pair(block_pairs(queries, blocks, count), _heads(k + 1), schema, columns)
    cutoff = _best(heads, k + 1).filter(F.col("place") == k + 1).select("v", F.col("score").alias("cutoff"))

    with_cutoff = written(merged(asked, cutoff, "v", "left").select("v", "vector", F.coalesce("cutoff", F.lit(LOWEST)).alias("extra")), "topk-cutoffs")
    queries = packed(with_cutoff.coalesce(groups), width, block_queries, "<i8")
    enough = each_pair(block_pairs(queries, blocks, count), _above(k + 1), schema, columns)
    best = _best(enough, k + 1).select("v", "c", "score")
    return answers(best, vecs, rows, is_query, k)
