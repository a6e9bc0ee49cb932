"""The searches over vectors, against brute force."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tracewell.llm import ann, catalog, topk


def embeddings():
    df = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    return df.vec_id.to_numpy(), np.stack(df.embedding).astype(float)


def brute(ids, rows, asked, k):
    out = []
    for i in np.flatnonzero(asked):
        score = rows @ rows[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out += [(int(ids[i]), n + 1, int(ids[j]), score[j]) for n, j in enumerate(order)]
    return sorted(out)


def test_op10(spark):
    ids, rows = embeddings()
    got = sorted(map(tuple, catalog.QUERIES["op10_top_k"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(ids, np.floor(256 * rows).astype(int), ids % 50 == 0, 5)


def test_op5(spark):
    ids, rows = embeddings()
    got = catalog.QUERIES["op5_nearest"](spark, SF).toPandas()
    want = brute(ids, rows, ids % 20 == 0, 20)
    pairs = set(zip(got.query_id, got.vec_id))
    assert len(got) == len(want) and sum((q, v) in pairs for q, _, v, _ in want) >= 0.9 * len(want)
    at = {v: i for i, v in enumerate(ids)}
    assert all(abs(rows[at[r.query_id]] @ rows[at[r.vec_id]] - r.score) < 1e-12 for r in got.itertuples())


@pytest.mark.parametrize("blocks", [(64, 16), (37, 5)])
def test_top_k_over_many_blocks(spark, blocks):
    ids, rows = embeddings()
    got = topk.exact_top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5, block_rows=blocks[0], block_queries=blocks[1])
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(ids, np.floor(256 * rows).astype(int), ids % 50 == 0, 5)


def test_top_k_of_large_components(spark):
    """Beyond doubles, beyond 64 bits, and beyond 64 bits on the way only."""
    dice = np.random.default_rng(5)
    rows = [[float(np.float32(x)) for x in dice.normal(size=6) * 10.0 ** dice.integers(0, 10)] for _ in range(120)]
    rows += [[1e9, 1e9, 0, 0, 0, 0], [1e9, -1e9, 1.0, 0, 0, 0], [3e38, 1, 1, 1, 1, 1], [-3e38, 1, 0, 0, 0, 0], [3e9, 3e9, -3e9, 3e9, -3e9, 1], [3e9, 3e9, 3e9, -3e9, 0, 2]]
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    top, low = (1 << 63) - 1, -(1 << 63)
    whole = [[max(low, min(top, math.floor(256 * Fraction(x)))) for x in r] for r in rows]
    want = []
    for i in range(0, len(rows), 3):
        scores = [(-max(low, min(top, sum(x * y for x, y in zip(whole[i], r)))), j) for j, r in enumerate(whole) if j != i]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:7])]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df, F.col("vec_id") % 3 == 0, 7, block_rows=50, block_queries=8)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


@pytest.mark.parametrize("shard_rows", [64, 130])
def test_nearest_over_several_shards(spark, shard_rows):
    ids, rows = embeddings()
    got = ann.nearest_neighbours(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20, shard_rows=shard_rows).toPandas()
    pairs, want = set(zip(got.query_id, got.vec_id)), brute(ids, rows, ids % 20 == 0, 20)
    assert sum((q, v) in pairs for q, _, v, _ in want) >= 0.95 * len(want)


def test_graph_recall():
    rows = np.random.default_rng(3).normal(size=(3000, 24)) * np.random.default_rng(4).uniform(0.5, 2, (3000, 1))
    graph, entry = ann.build_graph(rows)
    asked = rows[::30]
    pair = {"q_keys": np.arange(100).tobytes(), "keys": np.arange(3000).tobytes(), "q_matrix": asked.tobytes(), "matrix": rows.tobytes(), "graph": graph.tobytes(), "entry": entry}
    got = ann._searched(20)(pair).to_pandas()
    want = np.argsort(-(asked @ rows.T), axis=1)[:, :20]
    assert np.mean([len(set(want[i]) & set(got.c[got.v == i])) / 20 for i in range(100)]) >= 0.9


def plans_of_pairs(monkeypatch, module) -> list:
    """Takes the plans of the block pairs that a search makes."""
    made, real = [], module.block_pairs

    def kept(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(module, "block_pairs", kept)
    return made


def test_nearest_broadcasts_no_blocks(spark, monkeypatch):
    """Small enough for a broadcast by the planner's estimate, which knows nothing of the copies for every group."""
    made = plans_of_pairs(monkeypatch, ann)
    ann.nearest_neighbours(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20, shard_rows=64)
    assert [("Broadcast" in x._jdf.queryExecution().executedPlan().toString()) for x in made] == [False]


def test_top_k_broadcasts_no_blocks(spark, monkeypatch):
    made = plans_of_pairs(monkeypatch, topk)
    topk.exact_top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5, block_rows=64, block_queries=4)
    assert [("Broadcast" in x._jdf.queryExecution().executedPlan().toString()) for x in made] == [False, False]


@pytest.mark.parametrize("search, written_in, k", [(ann.nearest_neighbours, ann, 20), (topk.exact_top_k, topk, 5)])
def test_searches_broadcast_no_table(spark, monkeypatch, search, written_in, k):
    """Neither the written steps nor the result bring rows to the driver, though these are far below Spark's threshold."""
    plans, real = [], written_in.written

    def kept(df, name):
        plans.append(df)
        return real(df, name)

    monkeypatch.setattr(written_in, "written", kept)
    plans.append(search(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k))
    plans[-1].collect()
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [2.0]), (7, [2.0]), (8, [-1.0, -1.0]), (9, [])]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, v string, rank int, score int")


def test_top_k_of_odd_tables(spark, odd_vectors):
    got = topk.exact_top_k(odd_vectors, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 7, 131072), (0, 7, 131072), (0, 1, 65536), (50, 7, 131072), (50, 7, 131072), (50, 0, 65536), (100, 7, 65536), (100, 7, 65536), (100, 0, 32768)]
    everyone = topk.exact_top_k(odd_vectors, F.col("vec_id") % 50 == 0, 100).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in everyone} == {0: 8, 50: 8, 100: 8}
    assert topk.exact_top_k(odd_vectors.limit(0), F.col("vec_id") % 50 == 0, 3).count() == 0


def test_nearest_of_odd_tables(spark, odd_vectors):
    got = ann.nearest_neighbours(odd_vectors, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 7, 2.0), (0, 7, 2.0), (0, 1, 1.0), (50, 7, 2.0), (50, 7, 2.0), (50, 0, 1.0), (100, 7, 1.0), (100, 7, 1.0), (100, 0, 0.5)]
    assert ann.nearest_neighbours(odd_vectors.limit(0), F.col("vec_id") % 50 == 0, 3).count() == 0
