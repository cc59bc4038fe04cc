"""Sequence queries on whole texts against plain loops."""

import math
import re

import pytest

from strandloom import config
from strandloom.plans import registry

LETTERS = str.maketrans("BDEFHIJKLMNOPQRSUVWXYZ", "CAAGATCAGTTAACCGGATCTA")
TEXTS = {3: "a " * 260 + "the quick brown fox jumps over it. " * 20, 59: "It was a dark and stormy night; " * 40, 7: "short", 60: "-" * 150 + "A gap of signs, then the words begin here. " * 9, 0: ""}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    seqs = {d: "A" * (d % 60) + re.sub("[^A-Za-z]", "", t).upper().translate(LETTERS) for d, t in TEXTS.items()}
    return lambda name: {r[0]: r[1] if len(r) == 2 else tuple(r[1:]) for r in registry.QUERIES[name](spark, str(path)).collect()}, seqs


def tail(seq):
    n, e, best = len(seq), 0.0, (math.log(0.5) + len(seq) * math.log(0.25), 0)
    for k, base in enumerate(seq, 1):
        e += math.log(0.99) if base == "A" else math.log(0.01 / 3)
        score = math.log(0.5) + (k - 1) * math.log(0.9) + e + (math.log(0.1) + (n - k) * math.log(0.25) if k < n else 0)
        best = max(best, (score, k), key=lambda x: x[0])
    return best[1]


def test_tail_length(whole):
    got, seqs = whole
    want = {d: tail(s) for d, s in seqs.items()}
    assert want[3] > 120
    assert got("polya_tail") == want


def test_reverse_complement(whole):
    got, seqs = whole
    assert got("revcomp") == {d: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for d, s in seqs.items()}


def test_repeats(whole):
    got, seqs = whole

    def codes(s):
        return [sum("ACGT".index(b) << 2 * (7 - j) for j, b in enumerate(s[i : i + 8])) for i in range(5)]

    def hits(s):
        return sum(any((x ^ y).bit_count() <= 1 for x in codes(s[i : i + 12]) for y in codes(s[i + 20 : i + 32])) for i in range(len(s) - 31))

    want = {d: (len(s) - 31, hits(s)) for d, s in seqs.items() if len(s) >= 32}
    assert 60 in want and any(0 < n < of for of, n in want.values())
    assert got("kmer_rt_scan") == want


def test_consensus(whole):
    got, seqs = whole
    score = lambda x, y: config.CONS1[x] * config.CONS2[y] / (config.BGD[x] * config.BGD[y])
    want = {d: (len(s) - 22, max(score(s[i + 18], s[i + 19]) for i in range(len(s) - 22))) for d, s in seqs.items() if len(s) >= 23}
    assert {d: n for d, (n, _) in want.items()} == {d: n for d, (n, _) in got("maxent_consensus").items()}
    assert {d: x for d, (_, x) in got("maxent_consensus").items()} == pytest.approx({d: x for d, (_, x) in want.items()})


def test_growing_tails(whole):
    got, seqs = whole

    def grown(seq, first):
        n = min(first, len(seq))
        while True:
            t = tail(seq[:n])
            if t < n or n == len(seq):
                return t if t < n else len(seq)
            n = min(n + 50, len(seq))

    assert got("polya_tail_growing") == {d: grown(s, 30 + d % 7) if s else 0 for d, s in seqs.items()}
