"""Tab-separated sources and sinks: BED, intron tables, bedGraph, isoform maps, name lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import EXPANSION_SIZE, SCALE
from strandloom.functions.coords import mirrored, transcripts

BED12 = "chrom string, start long, end long, name string, score string, strand string, thick_start long, thick_end long, rgb string, block_count int, block_sizes string, block_starts string"
BED4 = "chrom string, start long, end long, id string"
BED6 = "chrom string, start long, end long, id string, score float, strand string"
POLYA8 = "chrom string, start long, end long, name string, score string, strand string, thick_start long, thick_end long"
BEDGRAPH = "chrom string, start long, end long, score double, strand string"
ISOFORMS = "gene string, transcript string"
INTRONS = (
    "chrom string, start long, end long, strand string, seen long, spanned long, splice_ai_donor float, splice_ai_acceptor float, max_ent_donor float, max_ent_acceptor float, donor_sequence string, acceptor_sequence string, "
    "donor_context string, acceptor_context string, intron_position string, is_toga_supported boolean, is_in_frame boolean, donor_rt_context string, acceptor_rt_context string, is_rt_intron boolean, is_nag_intron boolean, support string"
)
MAXENT_ACCEPTOR = "kmer string, " + ", ".join(f"s{i} double" for i in range(9))
MAXENT_DONOR = "kmer string, score double"


def _read(spark: SparkSession, paths: str | list[str], schema: str, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.csv(paths, schema=schema, sep="\t", comment="#", mode=mode, quote="")


def read_bed12(spark: SparkSession, paths: str | list[str], is_ref: bool = False) -> DataFrame:
    """Oriented transcripts of BED12 files; a malformed line is an error."""
    return transcripts(_read(spark, paths, BED12)).withColumn("is_ref", F.lit(is_ref))


def read_bed4(spark: SparkSession, paths: str | list[str], strand_aware: bool = True) -> DataFrame:
    """(chrom, start, end, id) shrunk by one at both sides like introns; with ``strand_aware`` the mirrored
    intervals are added, so that a blacklist acts on both strands. Malformed lines are dropped."""
    x = _read(spark, paths, BED4, "DROPMALFORMED").select("chrom", (F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end"), "id")
    return x.unionByName(x.select("chrom", (SCALE - F.col("end")).alias("start"), (SCALE - F.col("start")).alias("end"), "id")) if strand_aware else x


def read_bed6(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    x = _read(spark, paths, BED6, "DROPMALFORMED")
    s, e = mirrored(F.col("strand"), F.col("start"), F.col("end"))
    return x.withColumns({"start": s, "end": e})


def read_polya(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    x = _read(spark, paths, POLYA8)
    s, e = mirrored(F.col("strand"), F.col("start"), F.col("end"))
    cs, ce = mirrored(F.col("strand"), F.col("thick_start"), F.col("thick_end"))
    return x.withColumns({"start": s, "end": e, "cds_start": cs, "cds_end": ce}).drop("thick_start", "thick_end")


def end_windows(reads: DataFrame, size: int = EXPANSION_SIZE) -> DataFrame:
    """(chrom, start, end, name, strand): windows around the 3' ends of plain coordinates; starts below 200 are dropped."""
    at = F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("end"))
    return reads.where("start >= 200 and start <= end").select("chrom", (at - size).alias("start"), (at + size).alias("end"), "name", "strand")


def read_introns(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _read(spark, paths, INTRONS)


def read_bedgraph(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _read(spark, paths, BEDGRAPH)


def read_isoforms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _read(spark, paths, ISOFORMS, "DROPMALFORMED")


def read_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name): one per line."""
    return spark.read.text(paths).select(F.col("value").alias("name")).where("name <> ''").distinct()


def max_signal(rows: DataFrame) -> DataFrame:
    """Largest score per interval and strand."""
    return rows.groupBy("chrom", "start", "end", "strand").agg(F.max("score").alias("score"))


def nested_scores(rows: DataFrame) -> DataFrame:
    """(chrom, key, scores): all scores of a key, ascending."""
    return rows.groupBy("chrom", "key").agg(F.array_sort(F.collect_list("score")).alias("scores"))


def score_summary(nested: DataFrame) -> DataFrame:
    """(chrom, key, n, max_score, avg_score) of ``nested_scores``."""
    mean = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size("scores"))
    return nested.select("chrom", "key", F.size("scores").cast("long").alias("n"), F.array_max("scores").alias("max_score"), mean.alias("avg_score"))


def nested_attributes(rows: DataFrame, key: str, *attributes: str) -> DataFrame:
    """(chrom, key, attributes): all attribute tuples of a key, in order."""
    return rows.groupBy("chrom", F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(*attributes))).alias("attributes"))


def first_of_key(rows: DataFrame, key: Column | str, *order: str) -> DataFrame:
    """One row per chrom and key, the first in ``order``; null keys are left out."""
    keyed = rows.withColumn("key", F.col(key) if isinstance(key, str) else key).where("key is not null")
    pick = F.struct(*order, *(c for c in rows.columns if c not in order and c not in ("chrom", "key")))
    return keyed.groupBy("chrom", "key").agg(F.min(pick).alias("_r")).select("chrom", "key", "_r.*")


def key_of(column: str, split: tuple[str, int] | None = None, case: str | None = None, prefix: str = "", suffix: str = "", padding: int = 0) -> Column:
    """A column as key: one part of it (the whole where there is no such part), upper or lower case, with
    prefix and suffix, or a number moved by ``padding``, which never falls below 0 (text counts as 0)."""
    k = F.col(column).cast("string")
    if padding:
        return F.greatest(F.coalesce(F.expr(f"try_cast(`{column}` as bigint)"), F.lit(0)) + padding, F.lit(0)).cast("string")
    if split:
        parts = F.split(k, F.lit("\\Q" + split[0] + "\\E"))
        k = F.coalesce(F.get(parts, F.lit(split[1])), k)
    k = {"upper": F.upper, "lower": F.lower}.get(case, lambda x: x)(k)
    return F.concat(F.lit(prefix), k, F.lit(suffix))


def with_field(line: Column, place: int, value: Column | str) -> Column:
    """A tab-separated line whose field ``place`` (from 0) is ``value``: 3 renames a BED line, 8 recolours it.

    Lines with fewer fields stay as they are.
    """
    f = F.split(line, "\t", -1)
    new = F.lit(value) if isinstance(value, str) else value
    put = F.array_join(F.concat(F.slice(f, 1, place), F.array(new), F.slice(f, F.lit(place + 2), F.size(f))), "\t")
    return F.when(F.size(f) > place, put).otherwise(line)


def with_cds(tx: DataFrame, cds_start: Column, cds_end: Column) -> DataFrame:
    """Oriented transcripts with another CDS, kept within their bounds, as ``bed12_lines`` then renders it."""
    return tx.withColumns({"cds_start": F.greatest(cds_start, F.col("start")), "cds_end": F.least(cds_end, F.col("end"))})


def bedgraph_lines(scored: DataFrame) -> DataFrame:
    """(strand, line) of (chrom, start, end, score, strand): four bedGraph columns."""
    return scored.select("strand", F.concat_ws("\t", "chrom", "start", "end", F.col("score").cast("string")).alias("line"))


def write_bedgraph(scored: DataFrame, path: str) -> None:
    """One folder a strand, each part sorted by chrom and start."""
    ordered = scored.repartition("strand", "chrom").sortWithinPartitions("strand", "chrom", "start")
    bedgraph_lines(ordered).write.mode("overwrite").partitionBy("strand").text(path)


def read_max_entropy(spark: SparkSession, paths: str | list[str], schema: str = MAXENT_ACCEPTOR) -> DataFrame:
    """k-mers with their scores (MAXENT_ACCEPTOR: nine, MAXENT_DONOR: one); of repeated k-mers the first by value."""
    x = _read(spark, paths, schema)
    return x.groupBy(F.upper("kmer").alias("kmer")).agg(F.min(F.struct(*x.columns[1:])).alias("_s")).select("kmer", "_s.*")


def check_input(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".bed", ".tsv")) -> str:
    """``path`` if it is a non-empty file with one of the suffixes, in any store that Spark reads; else ValueError."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise ValueError(f"{path} does not exist")
    status = fs.getFileStatus(where)
    if not status.isFile():
        raise ValueError(f"{path} is not a file")
    if not path.endswith(suffixes):
        raise ValueError(f"{path} does not end in {' or '.join(suffixes)}")
    if status.getLen() == 0:
        raise ValueError(f"{path} is empty")
    return path


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.dropDuplicates(["line"])


def bed12_lines(tx: DataFrame) -> DataFrame:
    """(line) of oriented transcripts with name, score and rgb."""
    c = F.col
    s, e = mirrored(c("strand"), c("start"), c("end"))
    cs, ce = mirrored(c("strand"), c("cds_start"), c("cds_end"))
    plain = F.when(c("strand") == "-", F.array_sort(F.transform("exons", lambda x: F.struct((SCALE - x["end"]).alias("start"), (SCALE - x["start"]).alias("end"))))).otherwise(c("exons"))
    x = tx.withColumns({"_p": plain, "_s": s, "_e": e, "_cs": cs, "_ce": ce})
    each = lambda f: F.concat(F.array_join(F.transform("_p", lambda v: f(v).cast("string")), ","), F.lit(","))
    line = F.concat_ws("\t", "chrom", "_s", "_e", "name", "score", "strand", "_cs", "_ce", "rgb", F.size("_p"), each(lambda v: v["end"] - v["start"]), each(lambda v: v["start"] - c("_s")))
    return x.select(line.alias("line"))


def intron_lines(introns: DataFrame) -> DataFrame:
    """The 22-column lines of an intron table."""
    names = [f.split()[0] for f in INTRONS.split(", ")]
    return introns.select(F.concat_ws("\t", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    distinct_lines(lines.select("line")).write.mode("overwrite").text(path)
