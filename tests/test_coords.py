"""Coordinate vectors: clipping, gaps, mirroring, ORF mapping."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.config import SCALE as S
from strandloom.functions import coords, dna


def clipped(spark, strand, starts, sizes, start, end, cs, ce):
    row = spark.createDataFrame([(strand, start, end, cs, ce, sizes, starts)], "strand string, start long, end long, cs long, ce long, sizes string, starts string")
    a, b = coords.mirrored(F.col("strand"), F.col("cs"), F.col("ce"))
    x = row.withColumns({"a": a, "b": b}).withColumn("x", coords.clip_cds(coords.block_exons(F.col("strand"), F.col("start"), F.col("end"), F.col("sizes"), F.col("starts")), F.col("a"), F.col("b")))
    r = x.select("x", coords.introns(F.col("x")).alias("i")).first()
    return [tuple(e) for e in r.x], [tuple(e) for e in r.i]


@pytest.mark.parametrize("strand, expected", [("+", (10, 20)), ("-", (S - 20, S - 10))])
def test_mirrored(spark, strand, expected):
    a, b = coords.mirrored(F.lit(strand), F.lit(10), F.lit(20))
    assert tuple(spark.range(1).select(a, b).first()) == expected


def plain_clip(strand, blocks, cs, ce):
    """Exons cut to the CDS and the gaps between them, from the bases each exon has within it."""
    kept = []
    for s, e in blocks:
        if e >= cs and s <= ce:
            bases = [x for x in range(s, e + 1) if cs <= x <= ce]
            kept.append((bases[0], bases[-1]) if strand == "+" else (S - bases[-1], S - bases[0]))
    kept = sorted(set(kept))
    return kept, [(a[1] + 1, b[0] - 1) for a, b in zip(kept, kept[1:]) if b[0] - a[1] > 2]


@pytest.mark.parametrize("strand", ["+", "-"])
def test_cds_clip(spark, strand):
    rng = random.Random(8)
    for _ in range(6):
        at, blocks = rng.randrange(500), []
        for _ in range(rng.randrange(1, 9)):
            size = rng.randrange(1, 30)
            blocks.append((at, at + size))
            at += size + rng.randrange(1, 25)
        start, end = blocks[0][0], blocks[-1][1]
        cs = rng.randrange(start, end)
        ce = rng.randrange(cs, end + 1)
        tail = rng.choice(("", ","))
        sizes, starts = (",".join(str(v) for v in c) + tail for c in ([e - s for s, e in blocks], [s - start for s, _ in blocks]))
        assert clipped(spark, strand, starts, sizes, start, end, cs, ce) == plain_clip(strand, blocks, cs, ce)


def test_read_tags(spark):
    got = spark.range(1).select(coords.read_tags(F.lit("R1__FC3#TC12#PA40#PRx#IY985")).alias("t")).first().t
    assert got == {"FC": 3, "TC": 12, "PA": 40, "IY": 985}


def test_spliced_position_past_the_end_is_the_last_exon_end(spark):
    x = spark.sql("SELECT array(struct(10L start, 20L end), struct(30L start, 40L end)) e")
    assert [spark.range(1).crossJoin(x).select(coords.spliced_to_genome(F.col("e"), F.lit(p))).first()[0] for p in (0, 9, 10, 19, 20, 99)] == [10, 19, 30, 39, 40, 40]


def test_dna(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(dna.reverse_complement(F.lit("acgtN"))) == "NACGT"
    assert one(dna.cut(F.lit("ACGTAC"), 1, 4)) == "CGT"
    assert one(dna.skip(F.lit("ACGTAC"), 1, 4)) == "AAC"
    assert one(dna.fill(F.lit("C"), 3)) == "AAAC"
    assert one(dna.encode2(F.lit("ACTGN"))) == [0, 1, 2, 3]
    assert one(dna.consensus_score(F.lit("AAAAAAAAAAAAAAAAAAGTAAA"))) == pytest.approx(0.00016425120772946855, rel=1e-12)
    assert one(dna.rt_repeat(F.lit("ACGTACGTACGT"), F.lit("TTTTACGTACGC"))) is True
    assert one(dna.rt_repeat(F.lit("AAAAAAAAAAAA"), F.lit("TTTTTTTTTTTT"))) is False
