"""Alignments: features from CIGAR strings, poly-A tails, tagged BED12 rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import config
from strandloom.functions.dna import reverse_complement
from strandloom.operators import polya


def operations(cigar: Column) -> Column:
    """array<struct<n, op>>."""
    found = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))


def _total(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast("bigint"), lambda a, o: a + o["n"])


def features(records: DataFrame) -> DataFrame:
    """``records`` (name, flag, start, cigar, seq) with strand, five_clip, three_clip, matches, alignment_length, identity, end_site and seq in read direction.

    Identity counts ``=`` only, as per mille rounded, in percent; without ``=`` and ``X`` it is NaN.
    """
    x = records.withColumns({"_ops": operations(F.col("cigar")), "strand": F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")})
    clip = lambda k: F.when(F.try_element_at("_ops", F.lit(k))["op"].isin("S", "H"), F.try_element_at("_ops", F.lit(k))["n"]).otherwise(F.lit(0).cast("bigint"))
    minus = F.col("strand") == "-"
    x = x.withColumns({"_l": clip(1), "_r": clip(-1), "matches": _total(F.col("_ops"), "="), "alignment_length": _total(F.col("_ops"), "=XID"), "_ref": _total(F.col("_ops"), "=XMDN")})
    share = F.when(F.col("alignment_length") > 0, F.round(F.col("matches").cast("float") / F.col("alignment_length").cast("float") * 1000) / 10).otherwise(F.lit(float("nan")))
    return x.withColumns({
        "five_clip": F.when(minus, F.col("_r")).otherwise(F.col("_l")), "three_clip": F.when(minus, F.col("_l")).otherwise(F.col("_r")), "identity": share.cast("float"),
        "end_site": F.when(minus, F.col("start")).otherwise(F.col("start") + F.col("_ref")), "seq": F.when(minus, reverse_complement(F.col("seq"))).otherwise(F.col("seq")),
    }).drop("_l", "_r", "_ref")


def tails(reads: DataFrame, suffix: int = config.POLYA_SUFFIX, step: int = config.SUFFIX_STEP_SIZE, p2p: float = config.P2P, emit_a: float = config.EMIT_A) -> DataFrame:
    """``reads`` with polya_len (over the clip) and polya_read_len (over a suffix that grows while the tail fills it)."""
    end = lambda n: F.reverse(F.right("seq", n))
    clipped = polya.tail_length(end(F.col("three_clip").cast("int")), p2p, emit_a)
    x = reads.withColumn("polya_len", F.when(F.col("three_clip") > 0, clipped).otherwise(0).cast("bigint"))
    size = F.length("seq")
    read = polya.growing_tail(F.reverse("seq"), F.col("three_clip") + suffix, step, p2p, emit_a).cast("bigint")
    return x.withColumn("polya_read_len", F.greatest(F.col("polya_len"), F.when(size > 0, read).otherwise(0)))


def once(records: DataFrame) -> DataFrame:
    """Equal (name, start) once."""
    return records.dropDuplicates(["name", "start"])


def segment(records: DataFrame, tag: bool = True) -> DataFrame:
    """Tagged reads with verdict accept or reject; reads below the least identity are left out; equal (name, start) once."""
    x = tails(features(records)).withColumn("three_clip", F.col("three_clip") - F.least("polya_len", "three_clip"))
    x = x.withColumn("verdict", polya.read_quality(F.col("identity"), F.col("five_clip"), F.col("three_clip"))).where("verdict <> 'drop'")
    x = once(x)
    return x.withColumn("name", polya.tag_name(F.col("name"), F.col("five_clip"), F.col("three_clip"), F.col("polya_len"), F.col("polya_read_len"), F.col("identity"))) if tag else x


def to_bed12(reads: DataFrame) -> DataFrame:
    """BED12 columns; blocks are split at N."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("from"), F.array().cast("array<struct<s:bigint,n:bigint>>").alias("out"))
    block = lambda a: F.concat(a["out"], F.array(F.struct(a["from"].alias("s"), (a["at"] - a["from"]).alias("n"))))

    def step(a: Column, o: Column) -> Column:
        skip, uses = o["op"] == "N", o["op"].isin("M", "=", "X", "D", "N")
        at = a["at"] + F.when(uses, o["n"]).otherwise(0)
        return F.struct(at.alias("at"), F.when(skip, at).otherwise(a["from"]).alias("from"), F.when(skip, block(a)).otherwise(a["out"]).alias("out"))

    b = reads.withColumn("_ops", operations(F.col("cigar"))).withColumn("_b", F.aggregate("_ops", start, step, block))
    each = lambda f: F.concat(F.array_join(F.transform("_b", lambda v: v[f].cast("string")), ","), F.lit(","))
    last = F.element_at("_b", -1)
    end = F.col("start") + last["s"] + last["n"]
    return b.select("chrom", "start", end.alias("end"), "name", F.lit("60").alias("score"), "strand", F.col("start").alias("thick_start"), end.alias("thick_end"), F.when(F.col("verdict") == "accept", "43,118,219").otherwise("213,67,67").alias("rgb"), F.size("_b").alias("block_count"), each("n").alias("block_sizes"), each("s").alias("block_starts"))
