"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of n-grams of code points (A-Z folded) in the whole text. Training takes
a bounded sample of labelled rows: at most ``per_class`` rows of each label, those with the smallest
hash of the key. All its n-grams are counted in 2^SLOT_BITS hash slots, which screens them; those of
the best slots are counted again one by one (by 64-bit hash) and ranked by their log odds over its
standard error. The first ``features`` that ``min_df`` texts hold are kept, each is scaled by its
log-count ratio, and a logistic regression with L2 penalty is fitted. The intercept is moved to the
share of label 1 among all training labels. Scoring is one scan: a table lookup per n-gram, a sum
per passage of at most PASSAGE bytes, and the largest sum of a text's passages. A toxic passage so
weighs the same however much stands beside it; training texts are few passages long and stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _words
from strandloom.workspace import materialize

SIZES = (3, 4, 5, 6)
#: slots that screen n-grams for training, and slots before the table of features (small enough for a cache)
SLOT_BITS, FILTER_BITS = 22, 18
PER_CLASS = 4000
FEATURES = 4096
MIN_DF = 3
PASSAGE = 1600


@dataclass(frozen=True)
class Model:
    """Ascending hashes of the n-grams, their weights, and the intercept."""

    grams: np.ndarray
    weight: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES


def slots_of(grams: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Which of 2^bits slots hold any of the hashes."""
    held = np.zeros(1 << bits, bool)
    held[grams >> np.uint64(64 - bits)] = True
    return held


def gram_hashes(buf: np.ndarray, off: np.ndarray, sizes: tuple[int, ...] = SIZES, held: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the text and the 64-bit hash of every n-gram of code points that lies within one text and, if given, in the slots ``held``."""
    chars = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    c = _words.prefix_hash(buf)
    inv = _words.powers(len(c))[1][chars[:-1]]
    c = c[chars]
    ends = np.searchsorted(chars, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(ends))
    left = ends[1:][text] - np.arange(len(text))
    for n in sizes:
        if len(text) < n:
            continue
        h = (c[n:] - c[:-n]) * inv[: len(c) - n] + np.uint64(n)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = left[: len(h)] >= n
        if held is not None:
            inside &= held[h >> np.uint64(65 - len(held).bit_length())]
        at = np.flatnonzero(inside)
        yield text[at], h[at]


def _distinct(text: list[np.ndarray], value: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    t, v = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1]))) if len(t) else np.empty(0, bool)
    return t[new], v[new]


def slots(buf: np.ndarray, off: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot)."""
    keys = [t << SLOT_BITS | (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for t, h in gram_hashes(buf, off, sizes)]
    found = _words.distinct(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    return found >> SLOT_BITS, found & ((1 << SLOT_BITS) - 1)


def hashes_in(buf: np.ndarray, off: np.ndarray, sizes: tuple[int, ...], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) of the n-grams in the slots ``held``."""
    found = list(gram_hashes(buf, off, sizes, held))
    return _distinct([t for t, _ in found], [h for _, h in found])


def present(buf: np.ndarray, off: np.ndarray, sizes: tuple[int, ...], grams: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place of a feature in ``grams``)."""
    text, place = [], []
    for t, h in gram_hashes(buf, off, sizes, held):
        i = np.minimum(np.searchsorted(grams, h), max(len(grams) - 1, 0))
        hit = grams[i] == h if len(grams) else np.zeros(len(h), bool)
        text.append(t[hit]), place.append(i[hit])
    return _distinct(text, place)


def _sample(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int) -> DataFrame:
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lambda v: labels.where(usable & (F.col("y") == v)).orderBy(*order).limit(per_class)
    ids = pick(0).unionByName(pick(1))  # at most 2 * per_class rows of two numbers
    return materialize(docs.join(F.broadcast(ids), "doc_id").repartition(8, "doc_id"), "labelled")


def _count(sizes):
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << SLOT_BITS), np.int32)
        for batch in batches:
            buf, off = _words.utf8(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in _words.slices(off):
                doc, ids = slots(buf[off[i] : off[j]], off[i : j + 1] - off[i], sizes)
                for v in (0, 1):
                    at, times = np.unique(ids[y[i:j][doc] == v], return_counts=True)
                    n[v, at] += times.astype(np.int32)
        f = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(n[1][f].astype(np.int64)), pa.array(n[0][f].astype(np.int64))], names=["f", "pos", "neg"])

    return run


def _count_exact(sizes, held: np.ndarray):
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _words.utf8(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in _words.slices(off, 4 << 20):
                doc, h = hashes_in(buf[off[i] : off[j]], off[i : j + 1] - off[i], sizes, held)
                grams, inv = np.unique(h, return_inverse=True)
                one = y[i:j][doc] == 1
                pos, neg = (np.bincount(inv[m], minlength=len(grams)) for m in (one, ~one))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(pos), pa.array(neg)], names=["f", "pos", "neg"])

    return run


def _vectors(grams: np.ndarray, sizes):
    held = slots_of(grams)

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _words.utf8(batch.column(0))
            out = []
            for i, j in _words.slices(off):
                doc, ids = present(buf[off[i] : off[j]], off[i : j + 1] - off[i], sizes, grams, held)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                out += [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], names=["ids", "y"])

    return run


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on sparse entries."""
    w, b = np.zeros(n_features), 0.0
    if not len(y):
        return w, b
    # a bound on the curvature: largest row norm, plus the intercept
    lip = 0.25 * (np.bincount(rows, weights=values**2, minlength=len(y)).mean() * 4 + 1) + penalty
    wv, bv, t = w, b, 1.0
    for _ in range(steps):
        z = np.bincount(rows, weights=values * wv[cols], minlength=len(y)) + bv
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(cols, weights=values * g[rows], minlength=n_features) / len(y) + penalty * wv
        nw, nb, nt = wv - gw / lip, bv - g.mean() * 4 / lip, (1 + (1 + 4 * t * t) ** 0.5) / 2
        wv, bv = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES, sizes: tuple[int, ...] = SIZES, min_df: int = MIN_DF, penalty: float = 1e-4) -> Model:
    """Fit on the labelled rows where ``usable`` (an expression on doc_id) is true.

    Rows with a null key or label are not training rows; a null text is an empty one. A label given
    twice, or a repeated document, counts as often as it is there. Other columns are ignored. With
    one label only, or none (an empty table), the model has no features and an intercept at that
    share (half without labels).
    """
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    counts = known.where(usable).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    share = (counts.pos + 0.5) / (counts.n + 1)
    flat = Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))), sizes)
    sample = _sample(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), known, usable, per_class).select("text", "y")
    n = {r.y: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return flat
    p, q, P, Q = F.col("p") + 0.5, F.col("q") + 0.5, n[1] + 1.0, n[0] + 1.0
    z = F.abs(F.log(p / (P - p)) - F.log(q / (Q - q))) / F.sqrt(1 / p + 1 / (P - p) + 1 / q + 1 / (Q - q))

    def best(run, wanted: int) -> list:
        table = sample.mapInArrow(run, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
        return table.where(F.col("p") + F.col("q") >= min_df).orderBy(z.desc(), "f").limit(wanted).collect()  # bounded by the number of features

    held = np.zeros(1 << SLOT_BITS, bool)
    held[[r.f for r in best(_count(sizes), 2 * features)]] = True
    found = best(_count_exact(sizes, held), features)
    if not found:
        return flat
    grams = np.array([r.f for r in found], np.int64).view(np.uint64)
    p, q = np.array([r.p for r in found]) + 1.0, np.array([r.q for r in found]) + 1.0
    order = np.argsort(grams)
    grams, ratio = grams[order], np.log((p / (n[1] + 1)) / (q / (n[0] + 1)))[order]
    got = sample.mapInArrow(_vectors(grams, sizes), "ids array<int>, y int").toArrow()  # at most 2 * per_class rows
    y = got["y"].to_numpy().astype(float)
    ids = got["ids"].combine_chunks()
    rows = np.repeat(np.arange(len(y)), ids.value_lengths().to_numpy())
    cols = ids.flatten().to_numpy()
    w, b = logistic(rows, cols, ratio[cols], y, len(grams), penalty)
    drawn = n[1] / (n[0] + n[1])
    return Model(grams, w * ratio, float(b + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))), sizes)


def passages(buf: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the passages of all texts, and where each text's passages begin among them.

    A text longer than ``most`` bytes is cut behind the last white space of the second half of what fits, or,
    where there is none, before a character. An empty text is one empty passage.
    """
    long = np.flatnonzero(np.diff(off) > most)
    if not len(long):
        return off, np.arange(len(off) - 1)
    white = np.flatnonzero(_words.SEPARATOR[buf])
    cuts, count = [], np.ones(len(off) - 1, np.int64)
    for i in long.tolist():
        at, end = int(off[i]), int(off[i + 1])
        while end - at > most:
            k = int(np.searchsorted(white, at + most)) - 1
            if k >= 0 and white[k] >= at + most // 2:
                at = int(white[k]) + 1
            else:
                at += most
                while at < end and buf[at] & 0xC0 == 0x80:
                    at += 1
            if at < end:
                cuts.append(at)
                count[i] += 1
    return np.sort(np.concatenate((off, np.array(cuts, np.int64))), kind="stable"), np.cumsum(count) - count


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """``(doc_id, score)``, one row per input row, repeated ones too; a null or empty text gets the
    intercept's score. A very long text is scored by its passages, each of which counts. Other columns are
    ignored; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held = slots_of(m.grams)
        for batch in batches:
            buf, off = _words.utf8(batch.column(1))
            out = [np.empty(0)]
            for i, j in _words.slices(off):
                part = buf[off[i] : off[j]]
                cut, first = passages(part, off[i : j + 1] - off[i], passage)
                at, ids = present(part, cut, m.sizes, m.grams, held)
                out.append(np.maximum.reduceat(np.bincount(at, weights=m.weight[ids], minlength=len(cut) - 1), first) + m.bias)
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
