"""Preparation of a training corpus: stages applied one after the other to ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next stage's documents. Documents with a null text pass
as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from strandloom.workspace import materialize


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose combined share of good is below one half go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, *quality.sites_of_documents()).where("quality >= 0.5").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; every document stays with its other lines. ``n_chars``, if there is one, is counted anew."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"other{i}") for i, c in enumerate(others)))
    cut = line_dedup.dedup_lines(plain, min_words=1, carry=tuple(f"other{i}" for i in range(len(others))))
    back = cut.select("doc_id", F.col("kept").alias("text"), *(F.col(f"other{i}").alias(c) for i, c in enumerate(others)))
    if "n_chars" in others:
        back = back.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows of one id stay or go together."""
    gone = near_dedup.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    ranks, pattern = bpe.default_ranks()
    decoded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenize),
]
#: SQL cannot express the classifier, the sketches, the alignment or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
