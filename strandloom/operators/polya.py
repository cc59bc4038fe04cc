"""Poly-A: tail lengths, statistics from tags, location and intrapriming verdicts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import config
from strandloom.operators.intervals import point_join
from strandloom.workspace import materialize


def genomic_polya(pa: Column, pr: Column, tc: Column) -> Column:
    """A's that the genome explains: 0 if PA equals PR, else PR - (TC + PA); PA above PR, or a negative result, is an error."""
    left = pr - (tc + pa)
    return F.when(pa == pr, F.lit(0).cast("bigint")).when((pa > pr) | (left < 0), F.raise_error(F.concat_ws(" ", F.lit("inconsistent poly-A tags"), pa, pr, tc)).cast("bigint")).otherwise(left)


def _scores(seq: str, p2p: float, emit_a: float) -> np.ndarray:
    """By k, from 1: the score of the first k bases as tail, less that of none of them."""
    bases = np.frombuffer(seq.encode("utf-32-le"), "<u4") if not seq.isascii() else np.frombuffer(seq.encode(), np.uint8)
    k, found = np.arange(1, len(bases) + 1), np.cumsum(bases == ord("A"))
    return (k - 1) * math.log(p2p) + found * math.log(emit_a) + (k - found) * math.log((1 - emit_a) / 3) - k * math.log(0.25)


def _tail(seq: str, p2p: float, emit_a: float) -> int:
    if not seq:
        return 0
    scores = _scores(seq, p2p, emit_a)
    scores[:-1] += math.log(1 - p2p)
    k = int(np.argmax(scores))
    return k + 1 if scores[k] > 0 else 0


def _grown(seq: str, first: int, step: int, p2p: float, emit_a: float) -> int:
    """Looks at a stretch of bases that doubles until the tail ends in it."""
    size, looked = len(seq), first + step
    while True:
        filled = _scores(seq[:looked], p2p, emit_a)
        closed = np.concatenate([[0.0], filled + math.log(1 - p2p)])
        best = np.maximum.accumulate(closed)
        at = np.maximum.accumulate(np.where(closed > np.concatenate([[-np.inf], best[:-1]]), np.arange(len(closed)), 0))
        ends = np.arange(first, len(filled) + 1, step)
        ends = ends[ends > 0]
        if looked >= size and (not len(ends) or ends[-1] != size):
            ends = np.append(ends, size)
        short = ends[filled[ends - 1] <= best[ends - 1]]
        if len(short):
            return int(at[short[0] - 1])
        if looked >= size:
            return size
        looked *= 2


def tail_length(seq: Column, p2p: float = config.P2P, emit_a: float = config.EMIT_A) -> Column:
    """Poly-A length at the start of ``seq`` (the read's end, reversed): best path of a two-state model whose second state absorbs.

    One pass scores the first k bases as tail for all k; the best k wins (the smaller on ties).
    """
    run = F.arrow_udf(lambda seqs: pa.array([None if s is None else _tail(s, p2p, emit_a) for s in seqs.to_pylist()], pa.int32()), "int")
    return run(seq)


def growing_tail(seq: Column, first: Column, step: int = config.SUFFIX_STEP_SIZE, p2p: float = config.P2P, emit_a: float = config.EMIT_A) -> Column:
    """The tail over the first ``first`` bases of ``seq``, and over ``step`` more as long as it fills all of them; a tail that
    fills the whole of ``seq`` has its length.

    One pass for all lengths: a tail of k bases that ends before what is looked at scores the same, up to a term
    that all tails share, however much is looked at. So the best of them is carried along, and at each
    length only the tail that fills it is compared anew.
    """
    run = F.arrow_udf(lambda seqs, firsts: pa.array([None if s is None else _grown(s, f, step, p2p, emit_a) if s else 0 for s, f in zip(seqs.to_pylist(), firsts.to_pylist())], pa.int32()), "int")
    return run(seq, first.cast("int"))


def location_of_end(reads: DataFrame, projections: DataFrame, key: str = "k") -> DataFrame:
    """``reads`` with location: CDS if their end lies strictly within a projection of the component, else UTR."""
    p = projections.select("comp", F.col("start").alias("ps"), F.col("end").alias("pe"))
    inside = point_join(p.distinct(), reads.select(key, "comp", F.col("end").alias("re")), ["comp"], "ps", "pe", "re").where("ps < re and re < pe").select(key).distinct().withColumn("_in", F.lit(True))
    return reads.join(inside, key, "left").withColumn("location", F.when(F.col("_in"), "CDS").otherwise("UTR")).drop("_in")


def with_scores(reads: DataFrame, scores: DataFrame) -> DataFrame:
    """``reads`` with score: the largest of (chrom, end, score) at their end (``-``: mirrored end plus one); 0 without one."""
    best = scores.groupBy("chrom", F.col("end").alias("_at")).agg(F.max("score").alias("score"))
    at = F.when(F.col("strand") == "-", F.col("end") + 1).otherwise(F.col("end"))
    return reads.drop("score").withColumn("_at", at).join(best, ["chrom", "_at"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).drop("_at")


def end_chains(reads: DataFrame, wiggle: int = config.WIGGLE) -> DataFrame:
    """``reads`` (comp, end) with chain: ends of a component that differ by multiples of ``wiggle`` and follow each other within
    two of it share one, their smallest end. Reads of different chains never meet within {0, w, 2w}."""
    ends = reads.select("comp", "end").distinct()
    by = Window.partitionBy("comp", F.pmod("end", F.lit(wiggle))).orderBy("end")
    opens = F.coalesce(F.col("end") - F.lag("end").over(by) > 2 * wiggle, F.lit(True))
    chains = ends.withColumn("_opens", F.when(opens, F.col("end"))).select("comp", "end", F.last("_opens", ignorenulls=True).over(by).alias("chain"))
    return reads.join(chains, ["comp", "end"])


def intrapriming(reads: DataFrame, key: str = "k", wiggle: int = config.WIGGLE, max_gpa: int = config.GENOMIC_POLYA_THRESHOLD, min_polya: int = config.POLYA_LENGTH_THRESHOLD, threshold: float = config.APARENT_THRESHOLD, recover: bool = False) -> DataFrame:
    """(key, comp, is_supported, is_intrapriming, forced, ratio, category) for reads with comp, start, end, name, gpa, poly_a, score, location.

    Two ordered sweeps over a component (start, end descending, name, key): the first accepts by the
    read itself or by an accepted end within {0, w, 2w}; the second accepts the rest by position only.
    Reads act on each other along chains of ends only (``end_chains``), so each chain is swept by itself: reads
    are dealt by component and chain, sorted, and a task holds one chain at a time. Ratios are taken over components.
    """

    def sweep(good: list[bool], ends: list[int]) -> list[int]:
        seen: set[int] = set()
        state = [0] * len(ends)
        for turn in (1, 2):
            for i, end in enumerate(ends):
                near = (end, end - wiggle, end + wiggle)
                if not state[i] and ((turn == 1 and good[i]) or not seen.isdisjoint(near)):
                    seen.update(near)
                    state[i] = turn
        return state

    def judged(rows: list[tuple]) -> Iterator[tuple]:
        for (k, comp, *_), state in zip(rows, sweep([r[4] for r in rows], [r[3] for r in rows])):
            yield k, comp, state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32()))], names=[key, "comp", "state"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][1:3] != row[1:3]:
                    out += judged(held)
                    held = []
                held.append(row)
            if len(out) >= 10_000:
                yield table()
                out = []
        out += judged(held)
        if out:
            yield table()

    good = (F.col("gpa") < max_gpa) | (F.col("poly_a") >= min_polya) | (F.col("score") > threshold) | (F.col("location") == "UTR")
    cols = reads.select(F.col(key).cast("long").alias(key), F.col("comp").cast("long").alias("comp"), "start", F.col("end").cast("long").alias("end"), "name", F.coalesce(good, F.lit(False)).alias("good"))
    ordered = end_chains(cols, wiggle).repartition("comp", "chain").sortWithinPartitions("comp", "chain", "start", F.desc("end"), "name", key)
    swept = materialize(ordered.select(key, "comp", "chain", "end", "good").mapInArrow(run, f"{key} long, comp long, state int"), "swept")
    ratios = swept.groupBy("comp").agg(F.avg((F.col("state") == 0).cast("double")).cast("float").alias("ratio"))
    x = swept.join(ratios, "comp")
    plain = F.when(F.col("state") == 0, "intrapriming").otherwise("pass")
    category = F.when(F.col("ratio") > config.INTRAPRIMING_RATIO_THRESHOLD, "review").otherwise(plain) if recover else plain
    return x.select(key, "comp", (F.col("state") == 1).alias("is_supported"), (F.col("state") == 0).alias("is_intrapriming"), (F.col("state") == 2).alias("forced"), "ratio", category.alias("category"))


def filter_tails(reads: DataFrame, at_least: int = config.POLYA_LENGTH_THRESHOLD, above: bool = True) -> DataFrame:
    """Reads with a tail of at least (or below) a length; scores do not count, as in the matched tool."""
    return reads.where(F.col("poly_a") >= at_least) if above else reads.where(F.col("poly_a") < at_least)


def read_quality(identity: Column, clip5: Column, clip3: Column) -> Column:
    """drop, accept or reject."""
    good = (identity >= config.IDENTITY_THRESHOLD) & (clip5 <= config.MAX_CLIP5) & (clip3 <= config.MAX_CLIP3)
    return F.when(F.isnan(identity) | (identity < config.MINIMUM_IDENTITY), "drop").when(good, "accept").otherwise("reject")


def tag_name(name: Column, clip5: Column, clip3: Column, polya: Column, polya_read: Column, identity: Column) -> Column:
    return F.format_string("%s__FC%d#TC%d#PA%d#PR%d#IY%d", name, clip5, clip3, polya, polya_read, F.floor(identity * 10).cast("bigint"))
