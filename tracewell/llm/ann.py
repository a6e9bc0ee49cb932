"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard, searched by beams.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm: then the nearest by distance are those of
largest inner product, and the distances of the pruning rule are true ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import bounded_arrow, written
from tracewell.llm.vectors import answers, block_pairs, distinct_vectors, each_pair, matrix, merged, packed, usable, width_of

#: Rows of a shard, at most; out-edges of a node; beam of the build; by how much nearer a kept edge must bring one.
SHARD_ROWS, DEGREE, BUILD_BEAM, RELAX = 8192, 32, 72, 1.2
#: Beam of a search; queries of a block; nodes that a beam opens at once.
BEAM, BLOCK_QUERIES, OPENED = 128, 512, 4


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, trail: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nearest nodes met for each query, -1 where there are fewer, and their distances (but for |q|^2).

    All queries take a step at once: each opens the OPENED nearest nodes of its beam that aren't open yet and meets
    their out-neighbours, until all nodes of its beam are open. With `trail`, gives the opened nodes instead.
    """
    n, many = len(points), len(queries)
    ids = np.full((many, beam), -1, np.int32)
    far = np.full((many, beam), np.inf, np.float32)
    opened = np.zeros((many, beam), bool)
    met = np.zeros((many, n), bool)
    ids[:, 0], met[:, entry] = entry, True
    far[:, 0] = norms[entry] - 2 * (queries @ points[entry])
    path: list[np.ndarray] = []
    live = np.arange(many)
    while len(live):
        waiting = np.where(opened[live], np.inf, far[live])
        pick = np.argpartition(waiting, min(OPENED, beam - 1) - 1 if beam > 1 else 0, axis=1)[:, :OPENED]
        real = np.isfinite(np.take_along_axis(waiting, pick, 1))
        going = real.any(axis=1)
        live, pick, real = live[going], pick[going], real[going]
        if not len(live):
            break
        node = np.where(real, ids[live[:, None], pick], -1)
        opened[live[:, None], pick] |= real
        if trail:
            step = np.full((many, node.shape[1]), -1, np.int32)
            step[live] = node
            path.append(step)
        near = graph[node].reshape(len(live), -1)
        near[np.repeat(~real, graph.shape[1], axis=1)] = -1
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~met[live[:, None], near]
        row, col = np.nonzero(fresh)
        found = near[row, col]
        met[live[row], found] = True
        away = np.full(near.shape, np.inf, np.float32)
        away[row, col] = norms[found] - 2 * np.einsum("ij,ij->i", points[found], queries[live[row]])
        all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
        all_far = np.concatenate((far[live], away), axis=1)
        all_open = np.concatenate((opened[live], np.zeros(near.shape, bool)), axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        ids[live], far[live], opened[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_open))
    if trail:
        return np.concatenate(path, axis=1), far
    return ids, far


def robust_prune(points: np.ndarray, norms: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Out-edges of each node among its candidates (-1: none), nearest first; one that a kept edge comes RELAX times
    nearer to than the node itself is left out."""
    near = np.sort(np.where(near == nodes[:, None], -1, near), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    at = points[near]
    away = norms[near] + norms[nodes][:, None] - 2 * np.einsum("ijk,ik->ij", at, points[nodes])
    away[near < 0] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    near, away = np.take_along_axis(near, order, 1), np.take_along_axis(away, order, 1)
    keep = min(near.shape[1], int((away < np.inf).sum(axis=1).max(initial=0)))
    near, away = near[:, :keep], away[:, :keep]
    at = points[near]
    between = norms[near][:, :, None] + norms[near][:, None, :] - 2 * (at @ at.transpose(0, 2, 1))
    alive = np.isfinite(away)
    out = np.full((len(nodes), degree), -1, np.int32)
    every = np.arange(len(nodes))
    for k in range(degree):
        first = alive.argmax(axis=1) if keep else np.zeros(len(nodes), int)
        has = alive[every, first] if keep else np.zeros(len(nodes), bool)
        if not has.any():
            break
        out[has, k] = near[has, first[has]]
        alive &= RELAX**2 * between[every, first] > away
        alive[every, first] = False
    return out


def build_graph(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Out-edges of each vector of a shard, and the node where searches begin.

    From a random graph on, nodes come in random order, many at a time: a beam search for each proposes its
    candidates, pruning keeps the diverse ones, and they get an edge back, pruned again where they have too many.
    """
    n = len(vectors)
    dice = np.random.default_rng(seed)
    points = augmented(vectors)
    norms = np.einsum("ij,ij->i", points, points)
    middle = points.mean(axis=0)
    entry = int((norms - 2 * (points @ middle)).argmin())
    graph = np.full((n, DEGREE), -1, np.int32)
    if n <= DEGREE + 1:
        for k in range(n):
            graph[k, : n - 1] = np.delete(np.arange(n), k)
        return graph, entry
    graph[:, : DEGREE // 4] = dice.integers(0, n, (n, DEGREE // 4))
    order, at, size = dice.permutation(n), 0, 64
    while at < n:
        nodes = order[at : at + size]
        at, size = at + size, min(512, 2 * size)
        trail, _ = beam_search(points, norms, graph, entry, points[nodes], BUILD_BEAM, trail=True)
        graph[nodes] = robust_prune(points, norms, nodes, np.concatenate((trail, graph[nodes]), axis=1), DEGREE)
        back_to, source = graph[nodes].reshape(-1), np.repeat(nodes, DEGREE)
        source, back_to = source[back_to >= 0], back_to[back_to >= 0]
        by = np.argsort(back_to, kind="stable")
        source, back_to = source[by], back_to[by]
        target, begins, many = np.unique(back_to, return_index=True, return_counts=True)
        for low in range(0, int(many.max(initial=0)), DEGREE):  # so many new edges at a time
            some = np.flatnonzero(many > low)
            add = np.full((len(some), DEGREE), -1, np.int32)
            count = np.minimum(many[some] - low, DEGREE)
            row = np.repeat(np.arange(len(some)), count)
            col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            add[row, col] = source[np.repeat(begins[some] + low, count) + col]
            both = np.concatenate((graph[target[some]], add), axis=1)
            room = np.sort(both, axis=1)[:, ::-1]
            full = room[:, DEGREE] >= 0
            graph[target[some[~full]]] = room[~full, :DEGREE]
            for k in range(0, int(full.sum()), 1024):
                part = np.flatnonzero(full)[k : k + 1024]
                graph[target[some[part]]] = robust_prune(points, norms, target[some[part]], both[part], DEGREE)
    return graph, entry


def augmented(vectors: np.ndarray) -> np.ndarray:
    norms = np.einsum("ij,ij->i", vectors, vectors)
    more = np.sqrt(np.maximum(0, norms.max(initial=0) - norms))
    out = np.concatenate((vectors, more[:, None]), axis=1)
    scale = np.abs(out).max(initial=0)
    return (out / scale if scale else out).astype(np.float32)


def build_index(vecs: DataFrame, width: int, shards: int) -> DataFrame:
    """One row for each shard: block (its number), keys, matrix (the vectors as doubles), graph, entry. Every vector is in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []
        for batch in batches:
            keys.append(np.asarray(batch.column(0)))
            rows.append(matrix(batch.column(1), width, np.float64))
        if keys:
            vectors = np.concatenate(rows)
            graph, entry = build_graph(vectors)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate(keys).tobytes()]), pa.array([vectors.tobytes()], pa.binary()), pa.array([graph.tobytes()], pa.binary()), pa.array([entry], pa.int64())], ["block", "keys", "matrix", "graph", "entry"])

    return vecs.select("v", "vector").repartition(shards).mapInArrow(run, "block long, keys binary, matrix binary, graph binary, entry long")


def _searched(nearest: int):
    def run(pair: dict) -> pa.RecordBatch:
        q_keys, keys = np.frombuffer(pair["q_keys"], "<i8"), np.frombuffer(pair["keys"], "<i8")
        queries, vectors = np.frombuffer(pair["q_matrix"], "<f8").reshape(len(q_keys), -1), np.frombuffer(pair["matrix"], "<f8").reshape(len(keys), -1)
        points = augmented(vectors)
        scale = np.abs(queries).max(axis=1, initial=0, keepdims=True)
        asked = np.concatenate((queries / np.where(scale > 0, scale, 1), np.zeros((len(queries), 1))), axis=1).astype(np.float32)
        graph = np.frombuffer(pair["graph"], np.int32).reshape(len(keys), -1)
        ids, _ = beam_search(points, np.einsum("ij,ij->i", points, points), graph, pair["entry"], asked, min(BEAM, len(keys)))
        scores = np.einsum("ijk,ik->ij", vectors[ids], queries)
        scores[ids < 0] = -np.inf
        take = min(nearest, ids.shape[1])
        top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
        scores, ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        row, col = np.nonzero(ids >= 0)
        return pa.record_batch([pa.array(q_keys[row]), pa.array(keys[ids[row, col]]), pa.array(scores[row, col])], ["v", "c", "score"])

    return run


def nearest_neighbours(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k rows of largest inner product found for each query row: query_id, rank, vec_id, score (double).

    Distinct vectors are dealt evenly into shards of `shard_rows` at most; each shard gets a graph. Every query is
    searched in every shard and the shards' best are ranked, ties to the smaller id. Equal vectors are one node
    and are searched once. `is_query` is a condition on vec_id. A task holds one shard and one block of queries.

    Nulls: rows with a null id or vector, a component that is null or not finite, or zeros only take no part; a
    shorter vector counts as padded with zeros. Rows with equal ids are rows of their own; a query leaves out the
    rows with its id. With fewer candidates than k all are given. An empty table gives no rows. Other columns are
    not read.
    """
    bounded_arrow(df.sparkSession)
    rows = written(usable(df, id_col, vector_col, zero=False), "ann-rows")
    vecs = distinct_vectors(rows, k, "ann-vectors")
    width = max(1, width_of(vecs))
    shards = max(1, -(-vecs.count() // shard_rows))
    index = written(build_index(vecs, width, shards), "ann-index")
    asked = written(merged(rows.filter(is_query).select("vector").distinct(), vecs, "vector").select("v", "vector", F.lit(0).cast("long").alias("extra")), "ann-queries")
    queries = packed(asked.coalesce(1 + asked.count() // BLOCK_QUERIES), width, BLOCK_QUERIES, "<f8")
    pairs = block_pairs(queries, index, shards)
    found = each_pair(pairs, _searched(k + 1), "v long, c long, score double", ["q_keys", "q_matrix", "keys", "matrix", "graph", "entry"])
    return answers(found, vecs, rows, is_query, k)
