"""Approximate nearest neighbours by balanced posting lists.

Index. The number of centroids grows with the root of the number of vectors. They are fitted on a
bounded sample by balanced k-means (an overfull cluster pays a penalty). Every vector goes to the
posting list of its nearest centroid and, if it lies near a border (distance within ``1 + closure``
of the least), to further lists, unless a list already chosen is nearer to that centroid than the
vector is. Lists are dealt into blocks of bounded size, so a list that holds a third of all vectors
is still many tasks.

Search. A query walks a neighbour graph of the centroids (held in memory, size bounded by the
number of centroids) from a few entry points, best first. Edges go both ways; groups of centroids
that are near to none outside are tied to the rest by their shortest link and have an entry each, and
random long edges lead out of dense regions, so every list can be reached. All lists within
``1 + prune`` of the nearest centroid's distance are read, no fewer and no more. Within lists
similarities are exact. Vectors are compared by cosine, so the index works on unit vectors.

``prune`` is calibrated: for some vectors of the sample the true neighbours within the sample are
found by brute force, and the ratio is the least one whose lists hold the share ``recall`` of them.
In clusters that is a few lists, among evenly spread vectors of many dimensions a large part of all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm import _words
from strandloom.workspace import materialize

#: at most SAMPLE vectors reach the driver, SHARE for each centroid
SAMPLE, SHARE = 65_536, 64
CENTROIDS = 2048
BLOCK = 2048
REPLICAS, CLOSURE = 2, 0.1
LONG = 8
#: vectors of the sample that calibrate the ratio, and the share of their neighbours it must reach
TRIALS, RECALL = 400, 0.94


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    graph: list[np.ndarray]
    entries: np.ndarray
    prune: float = 0.0


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _unit(col: pa.Array) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that none overflows or vanishes."""
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 12, weight: float = 0.5) -> np.ndarray:
    """k unit centroids; a cluster above the mean size pays ``weight`` of the mean squared distance for each mean size above."""
    rng = np.random.default_rng(5)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)]
    size = np.zeros(k)
    for _ in range(rounds):
        d = 2 - 2 * x @ c.T
        a = (d + weight * d.min(axis=1).mean() * np.maximum(size * k / len(x) - 1, 0)).argmin(axis=1)
        size = np.bincount(a, minlength=k).astype(float)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, s / np.maximum(norm, 1e-9), x[rng.integers(0, len(x), k)])
    return c


def build(vectors: DataFrame, rows: int, sample: int = SAMPLE, centroids: int = CENTROIDS, degree: int = 24, k: int = 5, recall: float = RECALL) -> Index:
    """Centroids, their graph and the calibrated ratio for a table of ``rows`` vectors.

    They come from the rows with the smallest hash of the key, SHARE for each centroid and at most ``sample``.
    """
    lists = max(1, min(centroids, math.isqrt(rows)))
    found = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample, SHARE * lists)).select("v").toArrow()
    if not found.num_rows:
        return Index(np.empty((0, 0)), [], np.empty(0, np.int64))
    x = _unit(found["v"].combine_chunks())
    c = balanced_kmeans(x, min(lists, max(1, len(x) // 16)))
    index = Index(c, *connected(c, degree))
    return replace(index, prune=calibrated(index, x, k, recall))


def calibrated(index: Index, x: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> float:
    """Least ``prune`` for which the lists read hold the share ``recall`` of the k nearest in ``x`` of each of ``trials`` vectors."""
    c, needed = index.centroids, [np.zeros(1)]
    lists = posting_lists(index, x, CLOSURE, REPLICAS)
    owner = np.repeat(np.arange(len(x)), [len(n) for n in lists])
    flat = np.concatenate(lists)
    first = np.concatenate(([0], np.cumsum([len(n) for n in lists])[:-1]))
    for i in range(0, len(x), max(1, len(x) // trials)):
        s = x @ x[i]
        s[i] = -2
        near = np.argpartition(-s, min(k, len(x) - 1))[: min(k, len(x) - 1)]
        d = np.sqrt(np.maximum(2 - 2 * c @ x[i], 0))
        least = np.minimum.reduceat(d[flat], first) if len(owner) else d
        needed.append((least[near] + 1e-12) / (d.min() + 1e-12) - 1)
    return float(np.quantile(np.concatenate(needed), recall, method="higher")) + 1e-9


def _components(edge: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component; ``edge`` is symmetric."""
    label = np.arange(len(edge))
    while True:
        low = np.minimum(label, np.where(edge, label, len(edge)).min(axis=1))
        if (low == label).all():
            return label
        label = low


def connected(c: np.ndarray, degree: int, long: int = LONG) -> tuple[list[np.ndarray], np.ndarray]:
    """Neighbours of each centroid in a connected graph, and entry points in all groups that nearness alone does not tie together."""
    rng, n = np.random.default_rng(7), len(c)
    d = 2 - 2 * c @ c.T
    edge = np.zeros((n, n), bool)
    edge[np.arange(n)[:, None], np.argsort(d, axis=1)[:, 1 : degree + 1]] = True
    edge |= edge.T
    group = _components(edge)
    entries = np.union1d(np.arange(0, n, max(1, n // 8)), group)
    while group.any():
        mine = group == group.max()
        a, b = np.unravel_index(np.where(mine[:, None] & ~mine, d, np.inf).argmin(), d.shape)
        edge[a, b] = edge[b, a] = True
        group[mine] = group[b]
    far = rng.integers(0, n, (n, long))
    edge[np.arange(n)[:, None], far] = True
    edge |= edge.T
    return [np.flatnonzero(e) for e in edge], entries


def walk(index: Index, q: np.ndarray, prune: float, width: int = 32) -> np.ndarray:
    """Best-first walk of the centroid graph: the centroids within ``1 + prune`` of the nearest one's distance to q, nearest first.

    The walk goes on while the next centroid is that near, or among the ``width`` nearest seen.
    """
    c, seen = index.centroids, set(index.entries.tolist())
    dist = lambda n: np.sqrt(np.maximum(2 - 2 * c[n] @ q, 0)).tolist()
    todo = list(zip(dist(index.entries), index.entries.tolist()))
    best = [-a for a, _ in todo]
    low, found = min(todo)[0], []
    heapq.heapify(todo), heapq.heapify(best)
    while todo:
        a, b = heapq.heappop(todo)
        if len(best) >= width and a > -best[0] and a > (1 + prune) * low + 1e-9:
            break
        found.append((a, b))
        new = [n for n in index.graph[b].tolist() if n not in seen]
        seen.update(new)
        if new:
            for e, n in zip(dist(new), new):
                heapq.heappush(todo, (e, n))
                heapq.heappush(best, -e)
                low = min(low, e)
            while len(best) > width:
                heapq.heappop(best)
    return np.array([b for a, b in sorted(found) if a <= (1 + prune) * low + 1e-9])


def posting_lists(index: Index, x: np.ndarray, closure: float, replicas: int) -> list[list[int]]:
    """The lists of each unit vector, its nearest centroid's first."""
    c = index.centroids
    between = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
    out = []
    for p in range(0, len(x), 2048):
        d = np.sqrt(np.maximum(2 - 2 * x[p : p + 2048] @ c.T, 0))
        few = min(4 * replicas, d.shape[1])
        order = np.argpartition(d, few - 1, axis=1)[:, :few]
        order = np.take_along_axis(order, np.lexsort((order, np.take_along_axis(d, order, axis=1)), axis=1), axis=1)
        for i, near in enumerate(order.tolist()):
            chosen = [near[0]]
            for j in near[1:]:
                if len(chosen) == replicas or d[i, j] > (1 + closure) * d[i, near[0]]:
                    break
                if all(between[j, k] > d[i, j] for k in chosen):
                    chosen.append(j)
            out.append(chosen)
    return out


def _assign(lists_of):
    """Rows (list, vec_id, v) from the lists that ``lists_of`` gives for unit vectors."""

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = lists_of(_unit(batch.column(1)))
                t = batch.take(pa.array(np.repeat(np.arange(len(lists)), [len(n) for n in lists])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int32()), *t.columns], names=["list", "vec_id", "v"])

    return run


def _scan(k: int):
    @_words.lean
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not vectors.num_rows:
            return none
        raw = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        # powers of two take the largest component near one: exact, and nothing overflows
        scaled = lambda v: np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
        q, x = scaled(raw(queries)), scaled(raw(vectors))
        qid, vid = queries["vec_id"].to_numpy(), vectors["vec_id"].to_numpy()
        nx = np.sqrt((x * x).sum(axis=1))
        out = []
        for i in range(len(qid)):
            s = (x * q[i]).sum(axis=1) / (nx * np.sqrt((q[i] * q[i]).sum()))
            mine = np.flatnonzero(vid != qid[i])
            if len(mine) > k:
                edge = np.partition(s[mine], len(mine) - k)[len(mine) - k]
                mine = mine[s[mine] >= edge]
            mine = mine[np.lexsort((vid[mine], -s[mine]))][:k]
            out.append((np.full(len(mine), qid[i]), vid[mine], s[mine]))
        a, b, s = (np.concatenate(z) for z in zip(*out))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", sample: int = SAMPLE, centroids: int = CENTROIDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each row where ``is_query``.

    All other usable rows are candidates; score is the cosine in double precision; ties go to the
    smaller vec_id. Vectors that are null, empty, zero or hold a null or non-finite component, and
    rows with a null key, take no part; nor do vectors of another length than the commonest one (of
    equally common ones the smallest). Queries of one id are answered together, and candidates of
    one id are listed once, with the best score. Fewer candidates than k: all of them. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common.dim)
    index = build(rows, common.n, sample, centroids, k=k, recall=recall)
    shared, lists = spark.sparkContext.broadcast(index), len(index.centroids)
    entry = "list int, vec_id long, v array<double>"
    posted = materialize(rows.select("vec_id", "v").mapInArrow(_assign(lambda x: posting_lists(shared.value, x, CLOSURE, REPLICAS)), entry), "postings")
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"))  # one row a centroid at most
    blocks = F.broadcast(sizes.select("list", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int").alias("blocks")))
    dealt = posted.join(blocks, "list").select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answers(asked: DataFrame) -> DataFrame:
        asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
        found = asked.groupBy("list", "block").cogroup(dealt.groupBy("list", "block")).applyInArrow(_scan(k), "query_id long, vec_id long, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries = rows.where("q").select("vec_id", "v")
    found = materialize(answers(queries.mapInArrow(_assign(lambda x: [walk(shared.value, q, shared.value.prune) for q in x]), entry).join(blocks, "list")), "found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialize(queries.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    # queries whose lists hold fewer than k candidates are asked of all lists
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(answers(short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))).join(blocks, "list")))


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
