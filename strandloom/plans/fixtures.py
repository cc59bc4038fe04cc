"""Transcripts, scores and sequences made from the driver's tables.

One order is a transcript, one line number an exon. Names, tags and scores are integer functions of
the order key, so that every engine computes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import coords

#: The same rows as `exon_rows`, as SQL that DuckDB runs.
EXONS_SQL = """
ex AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
nx AS (SELECT k, n, q, lead(n) OVER (PARTITION BY k ORDER BY n) AS nn, min(n) OVER (PARTITION BY k) AS n0 FROM ex),
bl AS (SELECT k, n, 1000 + 150 * (k - k % 40) + n * 150 + (n * 11) % 20 + CASE WHEN n = n0 THEN (k % 4) * 10 ELSE 0 END AS s,
  1000 + 150 * (k - k % 40) + n * 150 + (n * 11) % 20 + CASE WHEN q >= 46 AND (nn IS NULL OR nn > n + 1) THEN 215 ELSE 60 + (n * 7) % 30 END AS e FROM nx),
plain AS (SELECT k, n, concat('chr', CAST(k % 5 AS VARCHAR)) AS chrom, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, k % 40 < 10 AS is_ref, s, e FROM bl),
exons AS (SELECT k, n, chrom, strand, is_ref, CASE WHEN strand = '-' THEN 100000000000 - e ELSE s END AS s, CASE WHEN strand = '-' THEN 100000000000 - s ELSE e END AS e FROM plain),
pt AS (SELECT k, min(s) AS ps, max(e) AS pe FROM plain GROUP BY k),
pc AS (SELECT k, ps, pe, ps + 30 AS pcs, greatest(ps + 30, pe - (k % 7) * 60) AS pce FROM pt),
tx AS (SELECT k, concat('chr', CAST(k % 5 AS VARCHAR)) AS chrom, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, k % 40 < 10 AS is_ref,
  CASE WHEN k % 2 = 1 THEN 100000000000 - pe ELSE ps END AS tstart, CASE WHEN k % 2 = 1 THEN 100000000000 - ps ELSE pe END AS tend,
  CASE WHEN k % 2 = 1 THEN 100000000000 - pce ELSE pcs END AS cs, CASE WHEN k % 2 = 1 THEN 100000000000 - pcs ELSE pce END AS ce FROM pc),
introns AS (SELECT k, chrom, strand, is_ref, e + 1 AS s, ns - 1 AS e FROM (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s, e) AS ns FROM exons) WHERE e + 1 < ns - 1)
"""


def exon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, chrom, strand, is_ref, s, e) in plain coordinates."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line.select("l_orderkey", "l_linenumber", "l_quantity").createOrReplaceTempView("_exon_source")
    return spark.sql("""
        WITH ex AS (SELECT l_orderkey k, l_linenumber n, CAST(max(l_quantity) AS BIGINT) q FROM _exon_source GROUP BY 1, 2),
        nx AS (SELECT k, n, q, lead(n) OVER (PARTITION BY k ORDER BY n) nn, min(n) OVER (PARTITION BY k) n0 FROM ex)
        SELECT k, n, concat('chr', k % 5) chrom, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END strand, k % 40 < 10 is_ref,
          1000 + 150 * (k - k % 40) + n * 150 + (n * 11) % 20 + CASE WHEN n = n0 THEN (k % 4) * 10 ELSE 0 END s,
          1000 + 150 * (k - k % 40) + n * 150 + (n * 11) % 20 + CASE WHEN q >= 46 AND (nn IS NULL OR nn > n + 1) THEN 215 ELSE 60 + (n * 7) % 30 END e
        FROM nx""")


def bed12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 columns, with k and is_ref."""
    x = exon_rows(spark, sf_dir)
    tx = x.groupBy("k", "chrom", "strand", "is_ref").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("b"))
    clip, polya = F.col("k") % 3, F.col("k") % 60
    tags = F.concat(F.lit("R"), F.col("k"), F.lit("_"), F.col("chrom"), F.lit("__FC"), F.col("k") % 5, F.lit("#TC"), clip, F.lit("#PA"), polya, F.lit("#PR"), F.when(F.col("k") % 4 == 0, polya).otherwise(polya + clip + F.col("k") % 9), F.lit("#IY"), 980 + F.col("k") % 20)
    ref = F.concat(F.lit("TX.G"), F.col("k") - F.col("k") % 40, F.lit("."), F.col("k"))
    joined = lambda f: F.concat(F.array_join(F.transform("b", f), ","), F.lit(","))
    return tx.select(
        "k", "is_ref", "chrom", "start", "end", F.when(F.col("is_ref"), ref).otherwise(tags).alias("name"), F.lit("0").alias("score"), "strand",
        (F.col("start") + 30).alias("thick_start"), F.greatest(F.col("start") + 30, F.col("end") - (F.col("k") % 7) * 60).alias("thick_end"), F.lit("0,0,0").alias("rgb"), F.size("b").alias("block_count"),
        joined(lambda x: (x["e"] - x["s"]).cast("string")).alias("block_sizes"), joined(lambda x: (x["s"] - F.col("start")).cast("string")).alias("block_starts"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.transcripts(bed12(spark, sf_dir))
