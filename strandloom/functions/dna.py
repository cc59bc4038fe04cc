"""DNA and strand functions as Column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import config

_CODES = np.zeros(256, np.uint8)
_CODES[list(b"CGT")] = 1, 2, 3


def complement(seq: Column) -> Column:
    """A<->T and C<->G in either case; N stays."""
    return F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn")


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(F.upper(seq)))


def cut(seq: Column, start: Column | int, end: Column | int) -> Column:
    """Half-open, 0-based slice."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))


def skip(seq: Column, start: int, end: int) -> Column:
    """The sequence without [start, end)."""
    return F.concat(cut(seq, 0, start), F.substring(seq, F.lit(end + 1), F.length(seq)))


def fill(seq: Column, k: int) -> Column:
    """k A's in front."""
    return F.concat(F.repeat(F.lit("A"), k), seq)


def fill_back(seq: Column, k: int) -> Column:
    """k A's behind."""
    return F.concat(seq, F.repeat(F.lit("A"), k))


def encode2(seq: Column) -> Column:
    """Bases as A 0, C 1, T 2, G 3; other characters are left out."""
    bases = F.filter(F.split(seq, ""), lambda b: b.isin("A", "C", "T", "G"))
    return F.transform(bases, lambda b: F.translate(b, "ACTG", "0123").cast("int"))


def reverse_encode2(seq: Column, start: int, end: int) -> Column:
    return encode2(F.reverse(cut(seq, start, end)))


def kmer_code(kmer: Column) -> Column:
    """A 0, C 1, G 2, T 3, N 0: two bits a base, first base highest."""
    return F.conv(F.translate(kmer, "ACGTN", "01230"), 4, 10).cast("long")


def rt_repeat(donor: Column, acceptor: Column, window: int = config.RT_WINDOW, mismatch: int = config.RT_MISMATCH) -> Column:
    """Whether any window of the donor context is within ``mismatch`` differing bits of one of the acceptor's.

    The distance counts bits of the two-bit codes, as the matched tools do: A<->C costs one, A<->T two.
    """

    def codes(seq: Column) -> Column:
        starts = F.when(F.length(seq) >= window, F.sequence(F.lit(1), F.length(seq) - (window - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: kmer_code(F.substring(seq, i, F.lit(window))))

    a, b = codes(donor), codes(acceptor)
    return F.exists(a, lambda x: F.exists(b, lambda y: F.bit_count(x.bitwiseXOR(y)) <= mismatch))


def _rt_places(seq: str, context: int, apart: int, window: int, mismatch: int) -> np.ndarray:
    """Windows are compared at all distances within the reach of a context, as bits of one number; a place looks at its windows' bits."""
    slack = context - window
    n = len(seq) - (apart + context) + 1
    if n <= 0:
        return np.empty(0, np.int32)
    bases = _CODES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)].astype(np.uint16 if window <= 8 else np.uint64)
    codes = bases[: len(seq) - window + 1].copy()
    for t in range(1, window):
        codes = (codes << 2) | bases[t : t + len(codes)]
    bits = np.zeros(n + slack, np.uint64)
    for i, k in enumerate(range(apart - slack, apart + slack + 1)):
        far = codes[k : k + n + slack]
        bits[: len(far)] |= (np.bitwise_count(codes[: len(far)] ^ far) <= mismatch).astype(np.uint64) << np.uint64(i)
    hit = np.zeros(n, bool)
    for x in range(slack + 1):
        hit |= bits[x : x + n] & np.uint64((1 << slack + 1) - 1 << slack - x) != 0
    return np.flatnonzero(hit).astype(np.int32)


def with_rt_sites(df: DataFrame, seq: str = "seq", context: int = config.RT_CONTEXT, apart: int = 20, window: int = config.RT_WINDOW, mismatch: int = config.RT_MISMATCH) -> DataFrame:
    """``df`` with rt_sites: the places (from 0) of whole sequences whose ``context`` bases are, by ``rt_repeat``, repeated in
    those ``apart`` bases on; empty where a sequence is too short. Work grows with the length."""
    run = F.arrow_udf(lambda seqs: pa.array([_rt_places(s or "", context, apart, window, mismatch) for s in seqs.to_pylist()], pa.list_(pa.int32())), "array<int>")
    return df.withColumn("rt_sites", run(F.col(seq)))


def with_consensus_scores(df: DataFrame, seq: str = "seq", width: int = 23) -> DataFrame:
    """``df`` with consensus_scores: ``consensus_score`` of every run of ``width`` bases, by place."""
    n = F.length(seq) - width + 1
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    x = df.withColumn("_v", F.split(seq, ""))
    return x.withColumn("consensus_scores", F.transform(places, lambda i: _consensus(F.get("_v", i + 18), F.get("_v", i + 19)))).drop("_v")


def _of(base: Column, table: dict[str, float]) -> Column:
    return reduce(lambda acc, kv: acc.when(base == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def consensus_score(seq: Column) -> Column:
    """Acceptor consensus of a 23-mer: its bases 18 and 19 against the background; null where the background is 0."""
    return _consensus(cut(seq, 18, 19), cut(seq, 19, 20))


def _consensus(first: Column, second: Column) -> Column:
    return F.try_divide(_of(first, config.CONS1) * _of(second, config.CONS2), _of(first, config.BGD) * _of(second, config.BGD))


def opposite(strand: Column) -> Column:
    return F.when(strand == "+", "-").when(strand == "-", "+")


def max_entropy_parts(seq: Column) -> tuple[list[Column], list[Column]]:
    """k-mers whose scores are multiplied, and those whose scores divide, for a 23-mer acceptor."""
    s = skip(seq, 18, 20)
    up = [cut(s, a, b) for a, b in ((0, 7), (7, 14), (14, 21), (4, 11), (11, 18))]
    down = [fill(cut(s, a, b), k) for a, b, k in ((4, 7, 4), (7, 11, 3), (11, 14, 4), (14, 18, 3))]
    return up, down


def max_entropy(seq: Column, table: Column) -> Column:
    """Maximum-entropy score with ``table``: map from k-mer to its nine scores; a missing k-mer counts 0, a zero divisor gives null."""
    up, down = max_entropy_parts(seq)
    score = lambda k, i: F.coalesce(F.try_element_at(F.try_element_at(table, k), F.lit(i + 1)), F.lit(0.0))
    product = lambda parts, first: reduce(lambda x, y: x * y, (score(k, first + i) for i, k in enumerate(parts)))
    return F.try_divide(product(up, 0), product(down, 5))


def acceptor_score(seq: Column, table: Column) -> Column:
    """log2(consensus * max entropy); 0 where the latter is 0 or missing."""
    me = F.coalesce(max_entropy(seq, table), F.lit(0.0))
    return F.when(me == 0, 0.0).otherwise(F.log2(consensus_score(seq) * me))
