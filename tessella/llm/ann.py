"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Vectors are dealt by a hash of their id into shards whose size grows with the square root of their number, from
``SHARD`` to ``MOST`` rows. Each shard gets its graph: from a start near the shard's centre, a greedy beam search for every vector proposes
neighbours among those it visits; relaxed distance pruning (a candidate goes if an already chosen neighbour is nearer
to it by the factor ``ALPHA``) keeps few edges in many directions; reverse edges are added and pruned alike. Beam
search then answers all queries in every shard, where distances are computed again in double precision on the original
vectors; the best ``k + 1`` of each shard are merged in two steps.

Graphs are rows (``shard, ids, vectors, edges``), so an index can be stored and read again. A group never holds more
than a shard; queries reach the shards in blocks of ``QUERY_BLOCK`` rows.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part; a row without an id takes none; ties go to the smaller id; rows repeated under one id are candidates
once (the copy read first in vector order); with few candidates all are returned; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD, DEGREE, BEAM, ALPHA = 4000, 40, 64, 1.2
#: Rows of the largest shard, and rows of a shard for each square root of a row.
MOST, GROWTH = 100_000, 16
#: Groups in which a query's answers from all shards are merged first.
MERGES = 64
SEARCH_BEAM, QUERY_BLOCK, BUILD_BLOCK = 100, 1024, 512


def _distances(base: np.ndarray, at: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squared distances of query rows to the base rows that ``at`` lists for each (single precision)."""
    found = base[at]
    found -= query[:, None, :]
    return np.einsum("qcd,qcd->qc", found, found)


def beam_search(base: np.ndarray, edges: np.ndarray, start: int, query: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query row the ``beam`` nearest rows reached from ``start`` (-1: fewer) and their squared distances.

    All queries move together: in each step every query expands its nearest unexpanded entry."""
    n, none = len(query), len(base)
    ids = np.full((n, beam), none, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = _distances(base, np.full((n, 1), start), query)[:, 0]
    seen = np.zeros((n, none + 1), bool)
    seen[:, start] = seen[:, none] = True
    active = np.arange(n)
    while len(active):
        at = np.where(done[active], np.inf, far[active]).argmin(1)
        go = ~done[active, at]
        active, at = active[go], at[go]
        if not len(active):
            break
        done[active, at] = True
        new = edges[ids[active, at]]
        new = np.where(seen[active[:, None], new], none, new)
        seen[active[:, None], new] = True
        d = _distances(base, np.minimum(new, none - 1), query[active])
        d[new == none] = np.inf
        all_ids, all_far = np.hstack([ids[active], new]), np.hstack([far[active], d])
        all_done = np.hstack([done[active], np.isinf(d)])
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        far[active] = np.take_along_axis(all_far, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
    return np.where(np.isinf(far), -1, ids), far


def robust_prune(base: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each row of ``own`` out of its ``candidates`` (``len(base)``: none)."""
    n, none = len(own), len(base)
    candidates = np.sort(candidates, axis=1)
    repeated = np.zeros(candidates.shape, bool)
    repeated[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    candidates = np.where(repeated | (candidates == own[:, None]), none, candidates)
    far = _distances(base, np.minimum(candidates, none - 1), base[own])
    far[candidates == none] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    width = int((~np.isinf(far)).sum(1).max(initial=0))
    candidates, far = candidates[:, :width], far[:, :width]
    out = np.full((n, degree), none, np.int64)
    if not width:
        return out
    alive, count, rows = ~np.isinf(far), np.zeros(n, np.int64), np.arange(n)
    vectors = base[np.minimum(candidates, none - 1)]
    square = np.einsum("ncd,ncd->nc", vectors, vectors)
    for _ in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        rows = np.flatnonzero(has)
        pick = alive[rows].argmax(1)
        out[rows, count[rows]] = candidates[rows, pick]
        count[rows] += 1
        chosen = vectors[rows, pick]
        between = square[rows] + square[rows, pick][:, None] - 2 * np.matmul(vectors[rows], chosen[:, :, None])[:, :, 0]
        gone = alpha * alpha * between <= far[rows]
        gone[np.arange(len(rows)), pick] = True
        alive[rows] &= ~gone
    return out


def build_graph(base: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (rows by ``degree``; ``len(base)``: none) and the start of searches."""
    n, rng = len(base), np.random.default_rng(7)
    start = int(((base - base.mean(0)) ** 2).sum(1).argmin())
    edges = np.full((n + 1, degree), n, np.int64)
    if n > 1:
        first = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)))
        edges[:n, : first.shape[1]] = first + (first >= np.arange(n)[:, None])
    order = rng.permutation(n)
    for at in range(0, n, BUILD_BLOCK):
        own = order[at : at + BUILD_BLOCK]
        found, _ = beam_search(base, edges, start, base[own], beam)
        edges[own] = robust_prune(base, own, np.hstack([np.where(found < 0, n, found), edges[own]]), degree, alpha)
        source, target = np.repeat(own, degree), edges[own].ravel()
        source, target = source[target < n], target[target < n]
        by = np.lexsort([source, target])
        source, target = source[by], target[by]
        first = np.flatnonzero(np.diff(target, prepend=-1))
        place = np.arange(len(target)) - np.repeat(first, np.diff(first, append=len(target)))
        for low in range(0, int(place.max(initial=-1)) + 1, degree):  # so many reverse edges at a time
            now = (place >= low) & (place < low + degree)
            to, row = np.unique(target[now], return_inverse=True)
            extra = np.full((len(to), degree), n, np.int64)
            extra[row, place[now] - low] = source[now]
            joined = np.hstack([edges[to], extra])
            known = np.sort(joined, axis=1)
            size = ((known < n) & (np.diff(known, axis=1, prepend=-1) != 0)).sum(1)
            full = size > degree
            if full.any():
                edges[to[full]] = robust_prune(base, to[full], joined[full], degree, alpha)
            rest = np.where(np.diff(known, axis=1, prepend=-1) != 0, known, n)
            edges[to[~full]] = np.sort(rest[~full], axis=1)[:, :degree]
    edges[n] = n
    return edges, start


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v array<double>``: one row per id, with a finite vector that isn't zero."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def build(vectors: DataFrame, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """The index of ``usable`` vectors: a row per shard (``shard, ids, vectors, edges, start``); ``shard``: its rows at least."""
    n = vectors.count()
    shards = max(1, math.ceil(n / min(max(shard, int(GROWTH * n**0.5)), max(shard, MOST))))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        exact = np.array(pdf["v"].tolist(), np.float64)
        edges, start = build_graph(_scaled(exact)[0], degree, beam, alpha)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "ids": [pdf["id"].to_numpy()], "vectors": [exact.ravel()], "edges": [edges.ravel().astype(np.int32)], "start": [start]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(graph, "shard int, ids array<bigint>, vectors array<double>, edges array<int>, start int")


def _scaled(exact: np.ndarray, query: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Single-precision copies in which distances neither overflow nor vanish."""
    scale = np.abs(exact).max(initial=0.0)
    scale = scale if np.isfinite(scale) and scale > 0 else 1.0
    return (exact / scale).astype(np.float32), None if query is None else (query / scale).astype(np.float32)


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, vec_id, score, shard``: the ``k + 1`` nearest indexed rows that each shard finds for every row of ``queries``
    (``id, v``), with distances in double precision."""
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    blocked = queries.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "v").groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    blocked = blocked.select("block", F.col("queries.id").alias("own"), F.flatten("queries.v").alias("asked"))
    # each shard meets each block of queries: every query asks every shard, as the method has it
    shards = index.agg(F.max("shard").alias("n")).first().n
    asked = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(0 if shards is None else shards))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, flat, ids, vectors, edges = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(5))
                start, number = batch.column(5)[i].as_py(), batch.column(6)[i].as_py()
                exact, query = vectors.reshape(len(ids), -1), flat.reshape(len(own), -1)
                edges = edges.astype(np.int64).reshape(len(ids) + 1, -1)
                base, near = _scaled(exact, query)
                for at in range(0, len(own), 256):
                    found, _ = beam_search(base, edges, start, near[at : at + 256], max(beam, 2 * k + 2))
                    found = found[:, : 2 * k + 2]  # more than k + 1, as single precision may swap neighbours
                    difference = exact[np.maximum(found, 0)] - query[at : at + 256, None, :]
                    score = np.where(found >= 0, np.sqrt(np.einsum("qcd,qcd->qc", difference, difference)), np.inf)
                    vec = np.where(found >= 0, ids[np.maximum(found, 0)], np.iinfo(np.int64).max)
                    best = np.lexsort([vec, score])[:, : k + 1]
                    score, vec = np.take_along_axis(score, best, 1), np.take_along_axis(vec, best, 1)
                    some = np.isfinite(score)
                    asking = np.repeat(own[at : at + 256], some.sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(asking), pa.array(vec[some]), pa.array(score[some]), pa.array(np.full(len(asking), number, np.int32))], ["query_id", "vec_id", "score", "shard"])

    return asked.join(index, "shard").select("own", "asked", "ids", "vectors", "edges", "start", "shard").mapInArrow(answer, "query_id bigint, vec_id bigint, score double, shard int")


def _smallest(members: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """The ``most`` smallest ids of each group, found in parts first, as one vector may hold a third of all rows."""
    ranked = lambda df, *keys: df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("member"))).filter(F.col("_at") <= most).drop("_at")
    parts = ranked(members.withColumn("_salt", F.pmod(F.xxhash64("member"), F.lit(salts))), "vec_id", "_salt")
    return ranked(parts.drop("_salt"), "vec_id")


def nearest(vectors: DataFrame, queries, k: int = 10, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every id that the Column function ``queries`` selects.

    The index holds each distinct vector once, under its smallest id; rows of equal vectors come back at the end, the
    ``k + 1`` smallest ids of each, which is all that ties can need."""
    rows = usable(vectors, id_col, vector_col).withColumn("_n", F.size("v"))
    rows = materialize(rows, "vectors")
    lengths = rows.groupBy("_n").count().orderBy(F.desc("count"), "_n").limit(1).collect()
    rows = rows.filter(F.col("_n") == (lengths[0]["_n"] if lengths else 0)).drop("_n")
    distinct = materialize(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct_vectors")
    index = materialize(build(distinct.select("id", "v"), shard), "graphs")
    found = search(index, rows.filter(queries(F.col("id"))), k)
    best_of = lambda df, most, *keys: df.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, most).alias("best"))
    few = best_of(found, k + 1, "query_id", F.pmod("shard", F.lit(MERGES)).alias("merge"))  # each merge sees its share of the shards
    found = few.select("query_id", F.explode("best").alias("x")).select("query_id", "x.*")
    found = best_of(found, k + 1, "query_id").select("query_id", F.explode("best").alias("x")).select("query_id", "x.*")
    members = rows.join(distinct.filter("n > 1").select("v", F.col("id").alias("vec_id")), "v").select("vec_id", F.col("id").alias("member"))
    every = found.join(_smallest(members, k + 1), "vec_id", "left").select("query_id", F.coalesce("member", "vec_id").alias("vec_id"), "score").filter("query_id <> vec_id")
    best = best_of(every, k, "query_id")  # k + 1 vectors with k + 1 rows each at most
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
