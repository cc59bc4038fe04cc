"""FASTA and FASTQ records, chunk numbers and split files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUFFIXES = ("fa", "fasta", "fa.gz", "fasta.gz", "fq.gz", "fastq.gz")


def kind(path: str) -> str:
    """fasta or fastq by suffix; others (plain FASTQ too) are an error."""
    found = next((s for s in SUFFIXES if path.endswith(f".{s}")), None)
    if found is None:
        raise ValueError(f"unsupported file: {path}")
    return "fastq" if "q" in found else "fasta"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of each record."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    return raw.select(F.element_at(lines, 1).alias("name"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record, name, seq, quality): groups of four lines, numbered from 0 over all files, by path and in file order."""
    lines = with_line_number(spark.read.text(path))
    r = lines.withColumns({"record": F.floor(F.col("position") / 4), "part": F.col("position") % 4})
    part = lambda k: F.max(F.when(F.col("part") == k, F.col("value")))
    return r.groupBy("record").agg(F.substring(part(0), 2, 1 << 30).alias("name"), part(1).alias("seq"), part(3).alias("quality"))


def with_line_number(lines: DataFrame) -> DataFrame:
    """The rows of a text scan with position: consecutive numbers from 0 by file path, split and line, however Spark
    deals splits to tasks.

    A split's lines follow one another in its task. Their number, and the first one's id, is counted
    first, one row a split; then each line takes its split's number of lines before it.
    """
    ids = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")).withColumn("_id", F.monotonically_increasing_id())
    counts = ids.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    counts = counts.select("_file", "_split", "_first", before.alias("_before"))
    return ids.join(counts, ["_file", "_split"]).withColumn("position", F.col("_before") + F.col("_id") - F.col("_first")).drop("_file", "_split", "_id", "_first", "_before")


def with_chunk(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with chunk: (place in ``order``) div ``size``. Sorted by range, then numbered per partition."""
    from strandloom.workspace import materialize

    placed = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    at = F.col("_before") + F.col("_id").bitwiseAND(2**33 - 1)
    return placed.join(F.broadcast(before), part == F.col("_p")).withColumn("chunk", F.floor(at / size)).drop("_id", "_p", "_before")


def split(records: DataFrame, order: list[str], chunk_size: int | None = None, files: int | None = None) -> DataFrame:
    """``records`` with chunk, by records per chunk or by number of files."""
    if (chunk_size is None) == (files is None):
        raise ValueError("give either chunk_size or files")
    if files is not None:
        chunk_size = max(1, -(-records.count() // files))
    return with_chunk(records, order, chunk_size)


def write_split(chunks: DataFrame, path: str, fastq: bool = False) -> None:
    """One gzip text folder a chunk."""
    text = F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "quality") if fastq else F.concat_ws("\n", F.concat(F.lit(">"), "name"), "seq")
    chunks.select("chunk", text.alias("value")).write.mode("overwrite").partitionBy("chunk").option("compression", "gzip").text(path)
