"""Scans of long sequences, given as expressions, take time in proportion to the length."""

import time

from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import alignments, polya

SIZE = 60_000


def made(spark):
    """60,000 letters that an expression makes from the row: 1,500 A, then runs of four bases."""
    body = F.translate(F.upper(F.regexp_replace(F.repeat(F.lit("ac-gt "), SIZE // 4), "[^a-z]", "")), "BD", "CA")
    return spark.range(2).select("id", F.concat(F.repeat(F.lit("A"), 1_500), body).alias("seq"))


def within(seconds, rows):
    began = time.time()
    got = rows.collect()
    assert time.time() - began < seconds
    return got


def test_tail_of_a_long_sequence(spark):
    assert [r.t for r in within(20, made(spark).select(polya.tail_length(F.col("seq")).alias("t")))] == [1_501] * 2


def test_growing_tails_of_long_reads(spark):
    reads = spark.range(0, 8, 1, 1).select(F.concat(F.reverse(F.regexp_replace(F.repeat(F.lit("AC-GT "), 250_000), "[^A-Z]", "")), F.repeat(F.lit("A"), 1_500)).alias("seq"), F.lit(50).alias("three_clip"))
    got = within(20, alignments.tails(reads).select("polya_len", "polya_read_len"))
    assert [tuple(r) for r in got] == [(50, 1_501)] * 8


def test_repeats_of_long_sequences(spark):
    seqs = spark.range(0, 8, 1, 1).select(F.regexp_replace(F.repeat(F.lit("AC-GT "), 250_000), "[^A-Z]", "").alias("seq"))
    got = within(20, dna.with_rt_sites(seqs).select(F.size("rt_sites").alias("n")))
    assert [r.n for r in got] == [1_000_000 - 31] * 8
