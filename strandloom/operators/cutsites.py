"""Cut-site profiles: window sequences, scoring with a pluggable model, simulated reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import config
from strandloom.functions.dna import reverse_complement

# Width and stride of the scored slices, smoothing taps.
WIDTH, STRIDE = 205, 10
SMOOTHING = (0.005, 0.01, 0.025, 0.05, 0.085, 0.175, 0.3, 0.175, 0.085, 0.05, 0.025, 0.01, 0.005)

Model = Callable[[list[str]], np.ndarray]


def window_sequences(windows: DataFrame, genome: DataFrame, tile: int = 65536) -> DataFrame:
    """``windows`` (chrom, start, end, name, strand) with seq in read direction; windows past a chromosome's end are left out.

    ``genome``: (chrom, tile, seq, chrom_size). A window no longer than a tile meets two at most.
    """
    sizes = genome.groupBy("chrom").agg(F.max("chrom_size").alias("_size"))
    x = windows.join(sizes, "chrom").where("start >= 0 and end <= _size").withColumn("_t", F.floor(F.col("start") / tile))
    left = genome.select("chrom", F.col("tile").alias("_t"), F.col("seq").alias("_l"))
    right = genome.select("chrom", (F.col("tile") - 1).alias("_t"), F.col("seq").alias("_r"))
    x = x.join(left, ["chrom", "_t"]).join(right, ["chrom", "_t"], "left")
    seq = F.upper(F.substring(F.concat("_l", F.coalesce("_r", F.lit(""))), (F.col("start") - F.col("_t") * tile + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return x.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq)).drop("_t", "_l", "_r", "_size")


def slice_starts(length: int) -> np.ndarray:
    """Where the slices of a sequence begin: every STRIDE bases up to the first one that reaches its end."""
    return np.arange(0, max(-(-(length - WIDTH) // STRIDE), 0) * STRIDE + 1, STRIDE)


def profiles(seqs: list[str], model: Model) -> list[np.ndarray]:
    """Mean cut probability per position of overlapping slices of each sequence, smoothed; ``model`` gives WIDTH numbers (or more) a slice.

    The slices of all sequences go through the model at once; sequences of one length are averaged and
    smoothed as one array. Those shorter than the smoothing are not smoothed.
    """
    starts = [slice_starts(len(s)) for s in seqs]
    slices = [s[a : a + WIDTH].ljust(WIDTH, "X") for s, at in zip(seqs, starts) for a in at.tolist()]
    if not slices:
        return []
    raw = np.asarray(model(slices))
    raw = raw.reshape(len(slices), -1)[:, :WIDTH].astype(float)
    first = np.concatenate(([0], np.cumsum([len(a) for a in starts])))
    length = np.array([len(s) for s in seqs])
    out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
    for n in np.unique(length).tolist():
        mine, at = np.flatnonzero(length == n), slice_starts(n)
        total, count = np.zeros((len(mine), n + len(SMOOTHING) - 1)), np.zeros(n)
        half = len(SMOOTHING) // 2
        for k, a in enumerate(at.tolist()):
            size = min(WIDTH, n - a)
            total[:, half + a : half + a + size] += raw[first[mine] + k, :size]
            count[a : a + size] += 1
        if n >= len(SMOOTHING):
            smooth = sum(w * total[:, k : k + n] for k, w in enumerate(SMOOTHING))
        else:
            smooth = total[:, half : half + n]
        for i, row in zip(mine.tolist(), smooth / np.maximum(count, 1)):
            out[i] = row
    return out


def profile(seq: str, model: Model) -> np.ndarray:
    """``profiles`` of one sequence."""
    return profiles([seq], model)[0]


def one_hot(seq: str, width: int = WIDTH) -> np.ndarray:
    """width x 4 numbers (A, C, G, T) of a slice; other letters, and what is missing at the end, are zeros."""
    codes = np.frombuffer(seq[:width].ljust(width, "X").encode(), np.uint8)
    return (codes[:, None] == np.frombuffer(b"ACGT", np.uint8)).astype(np.float32)


def peaks(p: np.ndarray, height: float = config.PEAK_HEIGHT, distance: int = config.PEAK_DISTANCE, prominence: float = config.PEAK_PROMINENCE) -> list[int]:
    """Places of local maxima (the middle of a plateau) of at least ``height``; of those nearer than
    ``distance`` the highest stays; then each must rise by ``prominence`` above the higher of the lows
    that part it from higher ground, or from the ends."""
    if len(p) < 3:
        return []
    start = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1))
    end, value = np.append(start[1:], len(p)), p[start]
    top = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1
    top = top[value[top] >= height]
    at = (start[top] + end[top] - 1) // 2
    kept: list[int] = []
    for i in at[np.lexsort((-at, -p[at]))].tolist():
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)

    def rise(i: int) -> float:
        above = np.flatnonzero(p > p[i])
        left, right = above[above < i], above[above > i]
        lo, hi = (int(left[-1]) + 1 if len(left) else 0), (int(right[0]) if len(right) else len(p))
        return float(p[i] - max(p[lo : i + 1].min(), p[i:hi].min()))

    return sorted(i for i in kept if rise(i) >= prominence)


def window_peaks(windows: DataFrame, load: Callable[[], Model], best_only: bool = False) -> DataFrame:
    """(chrom, position, name, place, score, strand): the peaks of each window's profile; ``best_only``: its highest place instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            out = []
            for w, p in zip(pdf.itertuples(), profiles(pdf["seq"].tolist(), model)):
                for i in [int(p.argmax())] if best_only and len(p) else peaks(p):
                    out.append((w.chrom, w.end - i - 1 if w.strand == "-" else w.start + i - 1, w.name, i, float(p[i]), w.strand))
            yield pd.DataFrame(out, columns=["chrom", "position", "name", "place", "score", "strand"])

    return windows.select("chrom", "start", "end", "name", "strand", "seq").mapInPandas(run, "chrom string, position long, name string, place long, score double, strand string")


def highest(scored: DataFrame, key: str = "name") -> DataFrame:
    """(key, start, score): the place of the largest score of each key, the first of equal ones."""
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("start").alias("start"))).alias("_b")).select(key, F.col("_b.start").alias("start"), (-F.col("_b.s")).alias("score"))


def score_windows(windows: DataFrame, load: Callable[[], Model], least: float = config.APARENT_THRESHOLD) -> DataFrame:
    """(chrom, start, end, id, score, strand) of positions that reach ``least``.

    ``load`` makes the model, once a task. Positions count from the window's 3' side on ``-``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            out = []
            for w, p in zip(pdf.itertuples(), profiles(pdf["seq"].tolist(), model)):
                for i in np.flatnonzero(p >= least).tolist():
                    at = w.end - i - 1 if w.strand == "-" else w.start + i - 1
                    out.append((w.chrom, at, at + 1, f"{w.name}_{i}", float(p[i]), w.strand))
            yield pd.DataFrame(out, columns=["chrom", "start", "end", "id", "score", "strand"])

    return windows.select("chrom", "start", "end", "name", "strand", "seq").mapInPandas(run, "chrom string, start long, end long, id string, score double, strand string")


def simulate_reads(spark: SparkSession, n: int, read_length: int, polya_range: int, sizes: dict[str, int], stranded: bool = True, seed: int = 0) -> DataFrame:
    """Random reads with a poly-A stretch in the middle: (chrom, start, end, name, strand, seq).

    Chromosomes shorter than a read get none. Each row depends on its number and ``seed`` only.
    """
    fit = sorted((k, v) for k, v in sizes.items() if v > read_length)
    if not fit:
        raise ValueError("no chromosome is longer than a read")
    pick = lambda salt, below: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(below) if isinstance(below, int) else below)
    chrom = F.element_at(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("size")) for k, v in fit)), (pick(1, len(fit)) + 1).cast("int"))
    bases = lambda salt, count: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt), i), F.lit(4)) + 1).cast("int"), F.lit(1))), "")
    half = read_length // 2
    x = spark.range(n).withColumns({"_c": chrom, "_p": pick(2, min(polya_range, half) + 1).cast("int")})
    x = x.withColumn("start", pick(3, (F.col("_c.size") - read_length).cast("long")))
    tail = F.when(F.col("_p") < half, bases(5, half - F.col("_p"))).otherwise("")
    return x.select(
        F.col("_c.name").alias("chrom"), "start", (F.col("start") + read_length).alias("end"), F.concat_ws("_", F.lit("read"), "id", "_p").alias("name"),
        F.when(F.lit(stranded) & (pick(4, 2) == 1), "-").otherwise("+").alias("strand"), F.concat(bases(6, F.lit(half)), F.repeat(F.lit("A"), F.col("_p")), tail).alias("seq"),
    )
