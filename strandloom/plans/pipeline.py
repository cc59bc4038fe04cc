"""The whole quality control as one plan: intron table, retention, truncation, poly-A, merged descriptor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.coords import read_tags
from strandloom.operators import classify, components, descriptor, polya, retention, truncation
from strandloom.operators.components import Mode, Overlap
from strandloom.workspace import materialize


def run(reads: DataFrame, annotation: DataFrame, scores: DataFrame, splice: DataFrame, key: str = "k") -> DataFrame:
    """One descriptor row a read, with category.

    ``reads`` and ``annotation``: transcripts with ``key`` and name; ``scores``: (chrom, end, score);
    ``splice``: (chrom, strand, site, pos, score). Components are found once and serve all modules.
    """
    tx = reads.withColumn("is_ref", F.lit(False)).unionByName(annotation.withColumn("is_ref", F.lit(True)), allowMissingColumns=True)
    packed = materialize(components.pack(tx, Overlap.EXON, Mode.INTRON, key), "packed")
    introns = classify.with_splice_scores(classify.intron_table(packed), splice)
    zero = F.lit(0.0)
    table = materialize(introns.withColumns({"me_donor": zero, "me_acceptor": zero, "is_rt": F.lit(False)}).withColumn("support", classify.support()), "introns")
    q, refs = packed.where("not is_ref"), packed.where("is_ref")
    kept = retention.verdicts(q, table, key).select(F.col(key).alias("id"), "intron_retention", "has_rt_intron", "exonic_status", "intronic_status", F.col("ratio").alias("component_retention_ratio"))
    cut = truncation.verdicts(packed, key).select(F.col(key).alias("id"), F.col("is_truncated").alias("is_read_truncated"), "is_novel_start")
    tagged = q.withColumn("t", read_tags(F.col("name"))).withColumns({"poly_a": F.coalesce(F.col("t")["PR"], F.lit(0)), "gpa": polya.genomic_polya(F.coalesce(F.col("t")["PA"], F.lit(0)), F.coalesce(F.col("t")["PR"], F.lit(0)), F.coalesce(F.col("t")["TC"], F.lit(0)))}).drop("t")
    ends = polya.intrapriming(polya.with_scores(polya.location_of_end(tagged, refs, key), scores), key).select(F.col(key).alias("id"), "is_intrapriming", F.col("is_supported").alias("is_poly_a_supported"), F.col("forced").alias("forced_poly_a"))
    merged = descriptor.merge(kept, cut, ends)
    lost = (F.col("exonic_status") == "DISCARD") & (F.col("intronic_status") == "DISCARD")
    return merged.withColumn("category", descriptor.category(F.col("is_intrapriming"), F.col("is_read_truncated"), F.col("has_rt_intron"), lost))
