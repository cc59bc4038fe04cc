"""Gene fusions: reads that overlap exons of several loci and share splice sites with several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import config
from strandloom.functions.coords import location
from strandloom.operators.intervals import overlap_join


def reference_loci(refs: DataFrame, comp: str = "comp") -> DataFrame:
    """``refs`` (clustered alone, with gene) with locus: overlapping genes of one component become one locus, named after all of them."""
    genes = F.array_sort(F.collect_set("gene").over(Window.partitionBy(comp)))
    return refs.withColumn("_g", genes).withColumn("locus", F.when(F.size("_g") > 1, F.array_join("_g", ".")).otherwise(F.col("gene"))).drop("_g")


def overlaps(packed: DataFrame, key: str = "k", match_intron: bool = False) -> DataFrame:
    """Per query: n_loci whose exons it overlaps, n_spliced whose splice sites (or introns) it shares.

    ``packed``: comp, is_ref, locus (of references), exons, introns.
    """
    exons = packed.select(key, "comp", "is_ref", "locus", F.explode("exons").alias("x")).select(key, "comp", "is_ref", "locus", F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    q = exons.where("not is_ref").select(key, "comp", F.col("s").alias("start"), F.col("e").alias("end"))
    r = exons.where("is_ref").select("comp", "locus", F.col("s").alias("start"), F.col("e").alias("end")).distinct()
    touched = overlap_join(q, r, ["comp"]).groupBy(key).agg(F.count_distinct("r_locus").alias("n_loci"))
    sites = F.transform("introns", lambda i: i) if match_intron else F.flatten(F.transform("introns", lambda i: F.array(i["start"], i["end"])))
    points = packed.select(key, "comp", "is_ref", "locus", F.explode(F.array_distinct(sites)).alias("site"))
    shared = points.where("not is_ref").select(key, "comp", "site").join(points.where("is_ref").select("comp", "locus", "site").distinct(), ["comp", "site"]).groupBy(key).agg(F.count_distinct("locus").alias("n_spliced"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return packed.where("not is_ref").join(touched, key, "left").join(shared, key, "left").withColumns({"n_loci": zero("n_loci"), "n_spliced": zero("n_spliced")})


def verdicts(packed: DataFrame, key: str = "k", match_intron: bool = False, recover: bool = False, banned: DataFrame | None = None) -> DataFrame:
    """One row per query: kind (real, fake, none), ratios, location and category.

    A fusion needs a component with several loci, exons of more than one and splicing with more than
    one; without the latter it is fake. ``banned`` (key) are never judged. With ``recover`` the
    queries of components whose real ratio reaches the threshold go to review.
    """
    loci = packed.where("is_ref").groupBy("comp").agg(F.count_distinct("locus").alias("comp_loci"), F.count("*").alias("ref_size"))
    x = overlaps(packed, key, match_intron).join(loci, "comp", "left").withColumns({"comp_loci": F.coalesce("comp_loci", F.lit(0)), "ref_size": F.coalesce("ref_size", F.lit(0))})
    if banned is not None:
        x = x.join(banned.select(key, F.lit(True).alias("_ban")).distinct(), key, "left").withColumn("_ban", F.coalesce("_ban", F.lit(False)))
    else:
        x = x.withColumn("_ban", F.lit(False))
    several = (F.col("comp_loci") > 1) & (F.col("n_loci") > 1) & ~F.col("_ban")
    x = x.withColumn("kind", F.when(several & (F.col("n_spliced") > 1), "real").when(several, "fake").otherwise("none"))
    by = Window.partitionBy("comp")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0)).over(by).cast("float")
    x = x.withColumns({"real_ratio": share(F.col("kind") == "real"), "fake_ratio": share(F.col("kind") == "fake"), "whole_ratio": share(F.col("kind") != "none"), "query_size": F.count("*").over(by)})
    category = F.when(F.col("kind") == "real", "fusions").when(F.col("kind") == "fake", "fakes").otherwise("pass")
    if recover:
        category = F.when(F.col("real_ratio") >= config.FUSION_RATIO_THRESHOLD, "review").otherwise(category)
    real = F.col("kind") == "real"
    return x.withColumns({"category": category, "location_of_fusion": F.when(real, location(F.col("chrom"), F.col("strand"), F.col("start"), F.col("end"))), "fusion_in_frame": real & ((F.col("cds_end") - F.col("cds_start")) % 3 == 0)}).drop("_ban")


def mapping_verdicts(packed: DataFrame, isoforms: DataFrame, key: str = "k") -> DataFrame:
    """Mapping mode: the locus is the gene of an isoform table (gene, transcript); a missing transcript is an error.

    Queries that overlap several genes but splice with one at most get category ``dropped``; the
    matched tool writes them to neither output.
    """
    genes = isoforms.groupBy(F.col("transcript").alias("name")).agg(F.min("gene").alias("locus"))
    named = packed.drop("locus").join(genes, "name", "left")
    checked = named.withColumn("locus", F.when(F.col("is_ref") & F.col("locus").isNull(), F.raise_error(F.concat(F.lit("no gene for transcript "), F.col("name")))).otherwise(F.col("locus")))
    out = verdicts(checked, key)
    return out.withColumn("category", F.when(F.col("kind") == "fake", "dropped").otherwise(F.col("category")))
