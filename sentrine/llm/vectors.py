"""Nearest neighbours by an inverted multi-index, and exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192  # vectors that one task holds at a time
TAME = 1 << 24  # components below give products of which 2 ** 15 fit a long


def usable(rows: DataFrame, zero: bool = True) -> DataFrame:
    """``(vec_id, v array<double>)`` of rows whose vectors are neither null nor hold null or non-finite components.

    Rows without vec_id take no part; with ``zero=False`` neither do zero vectors or empty ones.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return out if zero else out.where(F.exists("v", lambda x: x != 0.0))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()) if len(col) else np.empty((0, 0))


def _best(df: DataFrame, k: int, order) -> DataFrame:
    """The first k rows of each query. Every block has sent k rows at most, so this sorts k rows a block."""
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return df.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# ---------------------------------------------------------------- inverted multi-index


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _cells(q: np.ndarray, halves: list[np.ndarray], count: dict[tuple[int, int], int], want: int) -> list[tuple[int, int]]:
    """Centroid pairs in order of summed distance, by a heap over the two sorted lists, until ``want`` rows are covered."""
    h = len(q) // 2
    d = [((c - p) ** 2).sum(1) for c, p in zip(halves, (q[:h], q[h:]), strict=True)]
    o = [np.argsort(x, kind="stable") for x in d]
    heap, seen, out, have = [(d[0][o[0][0]] + d[1][o[1][0]], 0, 0)], {(0, 0)}, [], 0
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        cell = (int(o[0][i]), int(o[1][j]))
        if n := count.get(cell, 0):
            out.append(cell)
            have += n
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o[0]) and b < len(o[1]) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d[0][o[0][a]] + d[1][o[1][b]], a, b))
    return out


def _shards(sizes: dict[int, int], most: int = 4096) -> dict[int, tuple[int, int]]:
    """Of each cell its first shard and its number of shards: large cells are split, neighbouring small ones share one."""
    out, at, have = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        if n > most:
            at += have > 0
            out[cell] = (at, -(-n // most))
            at, have = at + out[cell][1], 0
        else:
            if have + n > most:
                at, have = at + 1, 0
            out[cell] = (at, 1)
            have += n
    return out


def multi_index_search(
    rows: DataFrame, queries: DataFrame, k: int = 10, centroids: int = 64, share: float = 0.6, fit_rows: int = 8192, seed: int = 7, query_block: int = 8192
) -> DataFrame:
    """k nearest rows by Euclidean distance for each query: ``query_id, rank, vec_id, score``.

    ``rows`` and ``queries`` have ``vec_id`` and ``embedding``; a query meets vectors of its own length, each of
    which has an index of its own. Null, zero or non-finite vectors take no part; no rows give no result. A query
    never finds its own vec_id; a vector repeated under other ids is found; ties go to the smaller vec_id.

    Codebooks of the two vector halves are fitted on at most ``fit_rows`` rows, chosen by hash; every row is
    indexed by its pair of centroids. For each query the pairs are visited by a heap in order of summed distance
    until they hold ``share`` of all rows, and more than k, all of which are reranked exactly. ``share`` is the price
    of recall in data without clusters (64 independent components leave a query's tenth neighbour at 0.8 of the mean
    distance, which no partition of the space tells apart); with clusters a few hundredths do. Cells are put together or split into shards of a few thousand rows by their
    counts, and queries are dealt in blocks, so a cell with a third of all rows makes no longer task than others and
    a query gets k rows from each shard at most.
    """
    spark = rows.sparkSession
    data, asked = usable(rows, zero=False), usable(queries, zero=False)
    lengths = sorted(r[0] for r in asked.select(F.size("v")).distinct().join(data.select(F.size("v")).distinct(), "size(v)").collect())
    if len(lengths) > 1:
        part = lambda df, n: df.where(F.size("embedding") == n)
        found = [multi_index_search(part(rows, n), part(queries, n), k, centroids, share, fit_rows, seed, query_block) for n in lengths]
        return reduce(DataFrame.union, found)
    sample = [] if not lengths else [r[0] for r in data.where(F.size("v") == lengths[0]).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(fit_rows).select("v").collect()]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample or not lengths:
        return empty
    dim = lengths[0]
    data, asked = data.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    x = np.array([v for v in sample if len(v) == dim])
    h = dim // 2
    halves = spark.sparkContext.broadcast([_kmeans(p, centroids, seed) for p in (x[:, :h], x[:, h:])])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = _matrix(pdf["v"])
            if len(m):
                a, b = (((c * c).sum(1)[None] - 2 * p @ c.T).argmin(1) for c, p in zip(halves.value, (m[:, :h], m[:, h:]), strict=True))
                pdf["cell"] = a * centroids + b
                yield pdf[["vec_id", "v", "cell"]]

    indexed = data.mapInPandas(assign, "vec_id long, v array<double>, cell long")
    # at most centroids ** 2 rows
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    total, pairs = sum(sizes.values()), {(c // centroids, c % centroids): n for c, n in sizes.items()}
    shards = _shards(sizes)
    shared = spark.sparkContext.broadcast((pairs, shards))
    want, blocks = max(k + 1, int(share * total)), asked.count() // query_block + 1

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, place = shared.value
        for pdf in batches:
            out = []
            for q, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                visits: dict[int, list[int]] = {}
                for a, b in _cells(np.asarray(v), halves.value, count, want):
                    first, n = place[a * centroids + b]
                    for shard in range(first, first + n):
                        visits.setdefault(shard, []).append(a * centroids + b)
                out += [(q, v, shard, cells) for shard, cells in visits.items()]
            yield pd.DataFrame(out, columns=["query_id", "v", "shard", "cells"])

    place = spark.createDataFrame([(c, *x) for c, x in shards.items()], "cell long, first int, n int")
    indexed = indexed.join(F.broadcast(place), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("n"))).cast("int"))
    indexed = indexed.select("vec_id", "v", "cell", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.mapInPandas(route, "query_id long, v array<double>, shard int, cells array<long>")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def rerank(key, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(d):
            d = d.sort_values("cell")
            m, ids, cells = _matrix(d["v"]), d["vec_id"].to_numpy(), d["cell"].to_numpy()
            norm = (m * m).sum(1)
            for qid, v, visit in zip(q["query_id"], q["v"], q["cells"], strict=True):
                mine = np.isin(cells, visit) & (ids != qid)
                ok = np.flatnonzero(mine)
                if len(ok) > k:
                    # squared distances by expansion are off by far less than this slack; what it leaves is measured exactly
                    near, slack = norm + v @ v - 2 * (m @ v), 1e-9 * (norm.max() + v @ v)
                    if np.isfinite(slack):
                        ok = ok[near[ok] <= np.partition(near[ok], k - 1)[k - 1] + slack]
                s = np.sqrt(((m[ok] - v) ** 2).sum(1))
                o = np.lexsort((ids[ok], s))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[ok][o], "score": s[o]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = asked.groupBy("shard", "block").cogroup(indexed.groupBy("shard", "block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    return _best(found, k, F.col("score"))


def op2_multi_index(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found for every hundredth vector of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return multi_index_search(rows, rows.where("vec_id % 100 = 0"))


# ---------------------------------------------------------------- exact top-k


def _bounded(data: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: int, k: int, step: int, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Top k of one block. ``data`` has a row per dimension; ``mass[b]`` the norms of what lies beyond block b."""
    alive = np.flatnonzero(ids != qid)
    part = np.zeros(len(alive), np.int64)
    for b, lo in enumerate(range(0, len(q), step)):
        part = part + q[lo : lo + step] @ data[lo : lo + step][:, alive]
        if len(alive) > k:
            room = np.ceil(mass[b][alive] * np.sqrt(float((q[lo + step :].astype(float) ** 2).sum())) * (1 + 1e-12))
            floor = np.partition(part - room, len(alive) - k)[len(alive) - k]
            keep = part + room >= floor
            alive, part = alive[keep], part[keep]
    o = np.lexsort((ids[alive], -part))[:k]
    return ids[alive][o], part[o]


def _wild(m: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k of rows or queries with components too large for sums in 64 bits: whole numbers of any size, held to the range of a long at the end."""
    at = np.flatnonzero(ids != qid)
    if not len(at):
        return ids[:0], np.empty(0, np.int64)
    whole = [int(x) for x in q]
    score = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * b for a, b in zip(m[:, i], whole, strict=True)))) for i in at]
    top = sorted(range(len(at)), key=lambda i: (-score[i], ids[at[i]]))[:k]
    return ids[at[top]], np.array([score[i] for i in top], np.int64)


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, step: int = 8, query_block: int = 8192) -> DataFrame:
    """k highest integer inner products of ``floor(scale * x)`` for each query: ``query_id, rank, vec_id, score``.

    Null vectors and such with null or non-finite components take no part; vectors of another length than the
    query's score nothing for it. Where sums may not fit a long (a component of ``TAME`` or more after scaling) they
    are made of whole numbers of any size, and scores beyond a long count as its largest or smallest value.
    A query never finds its own vec_id; ties go to the smaller vec_id. Empty inputs give an empty result.

    Queries and rows are dealt into a grid of blocks by hash; each block holds the vectors dimension by dimension,
    adds a few dimensions at a time and drops every candidate whose partial score plus the Cauchy-Schwarz bound of
    the remaining mass is below the k-th best guaranteed score. Nothing is dropped otherwise: the result is exact.
    """
    finite = ~F.exists("v", lambda x: F.abs(x * F.lit(float(scale))) == F.lit(float("inf")))  # floats of 32 bits never get there
    data, asked = usable(rows).where(finite), usable(queries).where(finite)
    nd, nq = data.count() // BLOCK + 1, asked.count() // query_block + 1
    d = data.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(nd))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))
    q = asked.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(nq))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nd - 1).cast("long"))))

    def block(key, qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, group in ds.groupby(ds["v"].map(len)):
            exact = np.floor(_matrix(group["v"]).T * float(scale)) if size else np.zeros((0, len(group)))
            wild = (np.abs(exact) >= TAME).any(0) | (size >= 1 << 15)
            every = group["vec_id"].to_numpy()
            m, ids = np.ascontiguousarray(exact[:, ~wild].astype(np.int64)), every[~wild]
            sq = m.astype(float) ** 2
            mass = [np.sqrt(sq[lo + step :].sum(0)) for lo in range(0, size, step)]
            for qid, v in zip(qs["vec_id"], qs["v"], strict=True):
                if len(v) == size:
                    q = np.floor(np.asarray(v) * float(scale))
                    if (np.abs(q) < TAME).all() and len(ids):
                        out.append((qid, *_bounded(m, ids, q.astype(np.int64), qid, k, step, mass)))
                        if wild.any():
                            out.append((qid, *_wild(exact[:, wild], every[wild], q, qid, k)))
                    else:
                        out.append((qid, *_wild(exact, every, q, qid, k)))
        out = [pd.DataFrame({"query_id": qid, "vec_id": got, "score": score}) for qid, got, score in out]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = q.groupBy("b", "c").cogroup(d.groupBy("b", "c")).applyInPandas(block, "query_id long, vec_id long, score long")
    return _best(found, k, F.desc("score"))


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 rows of highest integer inner product for every fiftieth vector of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(rows, rows.where("vec_id % 50 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
