"""Coordinates: mirrored space for the reverse strand, exons, introns, clipping, ORF mapping.

On ``-`` all positions are mirrored (SCALE - x), so that the first exon is always the 5'-most one,
``end`` is always the 3' end, and the strands never overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import SCALE

INTERVALS = "array<struct<start:bigint,end:bigint>>"


def mirrored(strand: Column, start: Column, end: Column) -> tuple[Column, Column]:
    reverse = strand == "-"
    return F.when(reverse, SCALE - end).otherwise(start), F.when(reverse, SCALE - start).otherwise(end)


def block_exons(strand: Column, start: Column, end: Column, sizes: Column, starts: Column) -> Column:
    """Sorted distinct exons (mirrored on ``-``) from comma lists of block sizes and starts; a trailing comma is allowed."""
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    both = F.zip_with(numbers(starts), numbers(sizes), lambda s, z: F.struct((start + s).alias("start"), (start + s + z).alias("end")))
    turned = F.when(strand == "-", F.transform(both, lambda x: F.struct((SCALE - x["end"]).alias("start"), (SCALE - x["start"]).alias("end")))).otherwise(both)
    return F.array_sort(F.array_distinct(turned))


def introns(exons: Column) -> Column:
    """Gaps of consecutive exons, shrunk by one at both sides; gaps below three bases are left out."""
    n = F.size(exons)
    gaps = F.zip_with(F.slice(exons, 1, F.greatest(n - 1, F.lit(0))), F.slice(exons, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct((a["end"] + 1).alias("start"), (b["start"] - 1).alias("end")))
    return F.filter(gaps, lambda g: g["start"] < g["end"])


def clip_cds(exons: Column, cds_start: Column, cds_end: Column) -> Column:
    """Exons cut to the CDS; those wholly outside are dropped, those that only touch it stay empty."""
    kept = F.filter(exons, lambda x: (x["end"] >= cds_start) & (x["start"] <= cds_end))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.struct(F.greatest(x["start"], cds_start).alias("start"), F.least(x["end"], cds_end).alias("end")))))


def clip_cds_bound(exons: Column, cds_start: Column, cds_end: Column) -> Column:
    """Exons that touch the CDS, cut where they cross one of its ends; an exon around the whole CDS stays whole."""
    kept = F.filter(exons, lambda x: (x["end"] >= cds_start) & (x["start"] <= cds_end))
    left = lambda x: F.when((x["start"] < cds_start) & (x["end"] < cds_end), cds_start).otherwise(x["start"])
    right = lambda x: F.when((x["start"] > cds_start) & (x["end"] > cds_end), cds_end).otherwise(x["end"])
    return F.transform(kept, lambda x: F.struct(left(x).alias("start"), right(x).alias("end")))


def first_exon(exons: Column) -> Column:
    return F.try_element_at(exons, F.lit(1))


def middle_exons(exons: Column) -> Column:
    """All exons but the 5'-most one."""
    return F.array_distinct(F.slice(exons, 2, F.greatest(F.size(exons) - 1, F.lit(0))))


def utr_bounds(start: Column, end: Column, cds_start: Column, cds_end: Column) -> Column:
    """struct<five_start, five_end, three_start, three_end>: what lies before and behind the CDS."""
    return F.struct(start.alias("five_start"), cds_start.alias("five_end"), cds_end.alias("three_start"), end.alias("three_end"))


def gene_token(name: Column) -> Column:
    """Second part of a dotted reference name."""
    return F.split_part(name, F.lit("."), F.lit(2))


def read_tags(name: Column) -> Column:
    """map<tag, value> of ``<id>__<tag>#<tag>...``; only two letters and an integer count as a tag."""
    parts = F.filter(F.split(F.split_part(name, F.lit("__"), F.lit(2)), "#"), lambda t: t.rlike("^..[0-9]+$"))
    return F.map_from_entries(F.transform(parts, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(3), F.length(t)).cast("bigint").alias("value"))))


def spliced_to_genome(exons: Column, pos: Column) -> Column:
    """Genome position of a spliced position; past the end: the end of the last exon."""
    start = F.struct(pos.cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        size = x["end"] - x["start"]
        here = acc["at"].isNull() & (acc["left"] < size)
        return F.struct((acc["left"] - F.when(acc["at"].isNull() & ~here, size).otherwise(0)).alias("left"), F.when(here, x["start"] + acc["left"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(exons, start, step, lambda acc: F.coalesce(acc["at"], F.try_element_at(exons, F.lit(-1))["end"]))


def orf_to_cds(exons: Column, strand: Column, orf_start: Column, orf_end: Column) -> tuple[Column, Column]:
    """CDS of an ORF in plain coordinates."""
    a, b = spliced_to_genome(exons, orf_start), spliced_to_genome(exons, orf_end)
    return F.when(strand == "-", SCALE - b).otherwise(a), F.when(strand == "-", SCALE - a).otherwise(b)


def location(chrom: Column, strand: Column, start: Column, end: Column) -> Column:
    """``chrom:start-end`` in plain coordinates."""
    s, e = mirrored(strand, start, end)
    return F.concat(chrom, F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string"))


def text(intervals: Column) -> Column:
    return F.array_join(F.transform(intervals, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")


def transcripts(bed12: DataFrame) -> DataFrame:
    """BED12 rows as oriented transcripts: name, chrom, strand, start, end, cds_start, cds_end, exons, introns, exon_len; other columns stay."""
    strand = F.col("strand")
    exons = block_exons(strand, F.col("start"), F.col("end"), F.col("block_sizes"), F.col("block_starts"))
    sizes = F.transform(F.filter(F.split("block_sizes", ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    start, end = mirrored(strand, F.col("start"), F.col("end"))
    cds_start, cds_end = mirrored(strand, F.col("thick_start"), F.col("thick_end"))
    out = bed12.withColumns({"exons": exons, "exon_len": F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x), "cds_start": cds_start, "cds_end": cds_end, "_s": start, "_e": end})
    return out.withColumns({"introns": introns(F.col("exons")), "start": F.col("_s"), "end": F.col("_e")}).drop("_s", "_e", "thick_start", "thick_end", "block_sizes", "block_starts", "block_count")
