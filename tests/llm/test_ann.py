"""Nearest neighbours: recall against brute force, exact scores, defined odd vectors."""

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import ann


def test_recall(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got = ann.search(df, F.col("vec_id") % 50 == 0).toPandas()
    e = df.toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    norm = np.linalg.norm(x, axis=1)
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i] / norm / norm[i]
        s[i] = -9
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, [s[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], atol=1e-12)
        hits += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(mine.vec_id))
        total += 5
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (50, [0.0, 0.0]), (100, [1.0, 1.0]), (None, [1.0, 0.0]), (7, [1.0, float("nan")]), (8, [1e300, 0.0]), (9, []), (10, [None, 1.0]), (11, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 8), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 8)]
    assert [round(r[3], 9) for r in got] == [1, 1, 0.707106781] + [0.707106781] * 3
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, [float(i), 1.0, -1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


def clusters(groups=10, each=400, dim=32):
    rng = np.random.default_rng(1)
    centre = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:groups]
    return np.repeat(centre, each, axis=0) + 0.02 * rng.normal(size=(groups * each, dim))


def test_walk_finds_the_lists_within_the_ratio(spark):
    x = clusters()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>")
    index = ann.build(df, len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for prune in (0.0, 0.5, 1e9):
        for q in unit[::50]:
            d = np.sqrt(np.maximum(2 - 2 * index.centroids @ q, 0))
            ids = ann.walk(index, q, prune)
            assert ids.tolist() == [i for i in np.lexsort((np.arange(len(d)), d)) if d[i] <= (1 + prune) * d.min() + 1e-9]


def test_recall_in_tight_clusters(spark):
    x = clusters()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, recall=0.995).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, len(x), 50):
        s = unit @ unit[i]
        s[i] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == i].vec_id))
    assert hits >= 0.99 * 5 * len(range(0, len(x), 50))


def measured(x):
    """Recall of the 5 nearest and the share of the vectors read, under the index's own ratio."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists = math.isqrt(len(x))
    few = unit[np.random.default_rng(0).permutation(len(x))[: min(ann.SAMPLE, ann.SHARE * lists)]]
    c = ann.balanced_kmeans(few, lists)
    index = ann.Index(c, *ann.connected(c, 24))
    index = replace(index, prune=ann.calibrated(index, few, 5, ann.RECALL))
    held = [[] for _ in c]
    for i, own in enumerate(ann.posting_lists(index, unit, ann.CLOSURE, ann.REPLICAS)):
        for j in own:
            held[j].append(i)
    hits = read = 0
    asked = range(0, len(x), len(x) // 200)
    for i in asked:
        s = unit @ unit[i]
        s[i] = -9
        seen = set().union(*(held[j] for j in ann.walk(index, unit[i], index.prune)))
        hits += len(seen & set(np.argsort(-s)[:5].tolist()))
        read += len(seen)
    return hits / 5 / len(asked), read / len(x) / len(asked)


def test_recall_and_share_read_by_the_ratio():
    rng = np.random.default_rng(3)
    recall, read = measured(np.repeat(rng.normal(size=(200, 64)), 100, axis=0) + 0.4 * rng.normal(size=(20_000, 64)))
    assert recall >= 0.98 and read < 0.05
    recall, read = measured(rng.normal(size=(20_000, 64)))
    assert recall >= 0.9 and read < 0.8


def test_lengths_and_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.1, 1.0]), (2, [1.0, 1.0, 1.0]), (3, [1.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [r[:3] for r in got] == [(50, 1, 1), (50, 2, 4)]
    assert got[0][3] == got[0][3] and abs(got[0][3] - 1 / 1.01**0.5) < 1e-12
