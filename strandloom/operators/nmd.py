"""Nonsense-mediated decay: one fold over the exons of a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import config


def _fold(exons: Column, cds_start: Column, cds_end: Column, distance: int) -> Column:
    last = F.size(exons) - 1
    zero = lambda v, n: F.lit(v).cast("bigint").alias(n)
    start = F.struct(zero(0, "i"), zero(-1, "n"), zero(0, "stop"), F.lit(False).alias("utr"), zero(0, "len"), zero(0, "cds"), zero(0, "bp"))

    def step(a: Column, x: Column) -> Column:
        s, e = x["start"], x["end"]
        after = e >= cds_end
        size = a["len"] + F.when(~after, 0).when(a["utr"], e - s).otherwise(e - cds_end)
        coding = (
            F.when((e < cds_start) | (s > cds_end), 0)
            .when((e >= cds_start) & (cds_start >= s), F.least(e, cds_end) - cds_start)
            .when((s > cds_start) & (e < cds_end), e - s)
            .when((s > cds_start) & (e >= cds_end), cds_end - s)
            .otherwise(0)
        )
        return F.struct(
            (a["i"] + 1).alias("i"), (a["n"] + F.when(after & (size >= distance), 1).otherwise(0)).alias("n"), F.when(after & (a["stop"] == 0), e - cds_end).otherwise(a["stop"]).alias("stop"),
            (a["utr"] | after).alias("utr"), size.alias("len"), (a["cds"] + coding).alias("cds"), F.when(after & (a["i"] == last), size - (e - s)).otherwise(a["bp"]).alias("bp"),
        )

    return F.aggregate(exons, start, step)


def classify_nmd(tx: DataFrame, nmd_distance: int = config.NMD_DISTANCE, weak_nmd_distance: int = config.WEAK_NMD_DISTANCE, atg_distance: int = config.ATG_DISTANCE, big_exon_dist: int = config.BIG_EXON_DIST_TO_EJ) -> DataFrame:
    """``tx`` with nmd_count, dist_stop_to_next_sj, cds_len, bp_utr_to_last_ejc and nmd (NN, SN<n>, WN<n>).

    Non-coding transcripts (empty CDS) are left out. If the stop lies at an exon's end the next exon
    overwrites the distance, as in the matched tool.
    """
    f = tx.where("cds_start <> cds_end").withColumn("_f", _fold(F.col("exons"), F.col("cds_start"), F.col("cds_end"), nmd_distance))
    n = F.col("_f.n")
    weak = (F.col("_f.bp") <= weak_nmd_distance) | (F.col("_f.stop") >= big_exon_dist) | (F.col("_f.cds") <= atg_distance)
    label = F.when(n <= 0, "NN").when(weak, F.concat(F.lit("WN"), n)).otherwise(F.concat(F.lit("SN"), n))
    out = f.withColumns({"nmd_count": n, "dist_stop_to_next_sj": F.col("_f.stop"), "cds_len": F.col("_f.cds"), "bp_utr_to_last_ejc": F.col("_f.bp"), "nmd": label}).drop("_f")
    rgb = F.when(F.col("nmd").startswith("SN"), config.STRONG_NMD_RGB).when(F.col("nmd").startswith("WN"), config.WEAK_NMD_RGB).otherwise(F.col("rgb")) if "rgb" in tx.columns else None
    tagged = F.when(F.col("nmd") == "NN", F.col("name")).otherwise(F.concat_ws(config.SEP, "name", "nmd"))
    return out.withColumn("name", tagged) if rgb is None else out.withColumns({"name": tagged, "rgb": rgb})
