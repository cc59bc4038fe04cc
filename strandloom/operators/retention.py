"""Intron retention and template-switch verdicts of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import config
from strandloom.functions.coords import location
from strandloom.operators.intervals import point_join


def retained(reads: DataFrame, introns: DataFrame, key: str = "k") -> DataFrame:
    """(read, intron) pairs where an exon strictly contains the intron; both sides have comp."""
    exons = reads.select(key, "comp", F.explode("exons").alias("x")).select(key, "comp", F.col("x.start").alias("es"), F.col("x.end").alias("ee"))
    return point_join(exons, introns, ["comp"], "es", "ee", "istart").where("es < istart and iend < ee").drop("es", "ee")


def rt_hits(reads: DataFrame, introns: DataFrame, key: str = "k") -> DataFrame:
    """(read, intron) pairs where the read itself has an intron of support RT."""
    own = reads.select(key, "comp", F.explode("introns").alias("i")).select(key, "comp", F.col("i.start").alias("istart"), F.col("i.end").alias("iend"))
    return own.join(introns.where("support = 'RT'"), ["comp", "istart", "iend"])


def contribution(position: Column, in_frame: Column, support: Column) -> Column:
    """What one retained intron says: 2 DISCARD, 1 UNCLEAR, 0 nothing."""
    return F.when(support == "RT", 0).when((position == "CDS") & ~in_frame & (support == "UNCLEAR"), 1).when((position == "CDS") & ~in_frame & (support == "SPLICED"), 2).when((position == "Unknown") & ~in_frame, 2).when(position == "Unknown", 1).otherwise(0)


def counters(verdicts: DataFrame) -> DataFrame:
    """One row: components, reads, reads with a retention, components whose ratio exceeds the threshold."""
    dirty = F.when(F.col("ratio") > config.RETENTION_RATIO_THRESHOLD, F.col("comp"))
    return verdicts.agg(F.count_distinct("comp").alias("components"), F.count("*").alias("reads"), F.count_if("intron_retention").alias("retentions"), F.count_distinct(dirty).alias("reviews"))


def verdicts(reads: DataFrame, introns: DataFrame, key: str = "k", recover: bool = False) -> DataFrame:
    """One row per read of a component with introns: arrays of hits, statuses, ratio and category.

    ``introns``: comp, chrom, strand, istart, iend, position, in_frame, support, ai_donor, ai_acceptor.
    Reads whose component has no intron are left out. With ``recover`` all reads of a component whose
    ratio exceeds the threshold go to review.
    """
    where = location(F.col("chrom"), F.col("strand"), F.col("istart"), F.col("iend"))
    hits = retained(reads, introns, key).withColumn("w", where)
    plain, rt = F.col("support") != "RT", F.col("support") == "RT"
    ordered = lambda cond, *cols: F.array_sort(F.collect_list(F.when(cond, F.struct("istart", "iend", *cols))))
    of_hits = hits.groupBy(key).agg(
        ordered(plain, "w", "support", "position", "in_frame", "ai_donor", "ai_acceptor").alias("h"), ordered(rt, "w").alias("r"),
        F.max(contribution(F.col("position"), F.col("in_frame"), F.col("support"))).alias("worst"),
    )
    of_own = rt_hits(reads, introns, key).withColumn("w", where).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("istart", "iend", "w"))).alias("o"))
    sizes = introns.groupBy("comp").agg(F.count("*").alias("ref_size"))
    by = Window.partitionBy("comp")
    x = reads.join(sizes, "comp").join(of_hits, key, "left").join(of_own, key, "left").withColumn("query_size", F.count("*").over(by))
    got = lambda c, f: F.coalesce(F.transform(c, lambda s: s[f]), F.array())
    n = F.when(F.col("h").isNull(), 0).otherwise(F.size("h"))
    status = {"exonic_status": F.when(F.col("worst") == 2, "DISCARD").when(F.col("worst") == 1, "UNCLEAR").otherwise("KEEP"), "intronic_status": F.when(F.col("o").isNotNull(), "DISCARD").otherwise("KEEP")}
    x = x.withColumns({"number_of_retentions": n.cast("bigint"), "intron_retention": n > 0, "retains_rt_intron": F.coalesce(F.size("r") > 0, F.lit(False)), "has_rt_intron": F.col("o").isNotNull(), **status})
    x = x.withColumn("ratio", F.avg(F.col("intron_retention").cast("double")).over(by).cast("float"))
    category = F.when((F.col("exonic_status") == "DISCARD") | (F.col("intronic_status") == "DISCARD"), "discard").otherwise("keep")
    if recover:
        category = F.when(F.col("ratio") > config.RETENTION_RATIO_THRESHOLD, "review").otherwise(category)
    return x.select(
        key, "comp", "number_of_retentions", "intron_retention", "retains_rt_intron", "has_rt_intron", "exonic_status", "intronic_status", "ref_size", "query_size", "ratio", category.alias("category"),
        got("h", "w").alias("coords_of_retention"), got("h", "support").alias("retention_support_type"), got("h", "position").alias("location_of_retention"), got("h", "in_frame").alias("is_intron_retained_in_frame"),
        got("h", "ai_donor").alias("retention_donor_score"), got("h", "ai_acceptor").alias("retention_acceptor_score"), got("r", "w").alias("retains_rt_intron_map"), got("o", "w").alias("has_rt_intron_map"),
    )
