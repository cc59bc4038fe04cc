"""Registered queries that write the binary formats from the tables and read them again, and queries on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import alignments, classify, polya
from strandloom.operators.components import Mode
from strandloom.plans import fixtures
from strandloom.plans.registry import BASE, INTRON_TABLE, TAIL_SQL, _packed_once, new_folder, query, tails
from strandloom.sources import binary, sequences


def _sizes(rows: DataFrame, end: str = "end") -> dict[str, int]:
    return {r.chrom: r.size for r in rows.groupBy("chrom").agg(F.max(end).alias("size")).orderBy("chrom").collect()}


# --- BAM --------------------------------------------------------------------------------------------

#: Alignments of the transcripts: exons are matches, introns gaps, every ninth has no place.
BAM_SQL = BASE + """,
px AS (SELECT k, s, e, lead(s) OVER (PARTITION BY k ORDER BY s, e) AS ns FROM plain),
al AS (SELECT px.k, string_agg(concat(e - s, 'M', CASE WHEN ns IS NOT NULL THEN concat(ns - e, 'N') ELSE '' END), '' ORDER BY s, e) AS cigar, CAST(sum(e - s) AS INT) AS n FROM px GROUP BY px.k),
rd AS (SELECT concat('r', k) AS name, CASE WHEN k % 9 = 0 THEN 4 WHEN k % 2 = 1 THEN 16 ELSE 0 END AS flag, CASE WHEN k % 9 <> 0 THEN concat('chr', k % 5) END AS chrom, CASE WHEN k % 9 = 0 THEN -1 ELSE ps END AS "start",
 CAST(k % 61 AS INT) AS mapq, CASE WHEN k % 9 = 0 THEN '' ELSE cigar END AS cigar, substring(repeat('ACGGTTNA', 1 + n // 8), 1, n) AS seq, CASE WHEN k % 4 = 0 THEN 'reject' ELSE 'accept' END AS verdict, CASE WHEN k % 9 = 0 THEN -1 ELSE pe END AS stop FROM al JOIN pt USING (k))"""


def aligned(spark, sf: str) -> DataFrame:
    bed = fixtures.bed12(spark, sf)
    k, lost = F.col("k"), F.col("k") % 9 == 0
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    x = bed.withColumns({"_n": ints("block_sizes"), "_s": ints("block_starts")})
    gaps = F.transform(F.sequence(F.lit(1), F.size("_n")), lambda i: F.concat(F.get("_n", i - 1).cast("string"), F.lit("M"), F.when(i < F.size("_n"), F.concat((F.get("_s", i) - F.get("_s", i - 1) - F.get("_n", i - 1)).cast("string"), F.lit("N"))).otherwise("")))
    total = F.aggregate("_n", F.lit(0).cast("long"), lambda a, b: a + b)
    seq = F.substring(F.expr("repeat('ACGGTTNA', cast(1 + aggregate(_n, 0L, (a, b) -> a + b) div 8 as int))"), F.lit(1), total.cast("int"))
    return x.select(
        F.concat(F.lit("r"), k).alias("name"), F.when(lost, 4).when(k % 2 == 1, 16).otherwise(0).alias("flag"), F.when(~lost, F.col("chrom")).alias("chrom"), F.when(lost, F.lit(-1)).otherwise(F.col("start")).cast("long").alias("start"),
        (k % 61).cast("int").alias("mapq"), F.when(lost, "").otherwise(F.array_join(gaps, "")).alias("cigar"), seq.alias("seq"), F.when(k % 4 == 0, "reject").otherwise("accept").alias("verdict"), "end",
    )


def _written_bam(spark, sf: str, indexed: bool) -> str:
    binary.register(spark)
    path, reads = new_folder(spark, "bam"), aligned(spark, sf)
    binary.write_bams(reads.drop("end"), path, _sizes(reads.where("chrom is not null")), indexed)
    return path


@query("bam_reads", BAM_SQL + " SELECT name, flag, chrom, \"start\", mapq, cigar, seq, verdict FROM rd")
def bam_reads(spark, sf):
    """Good and bad reads, written in one pass and read in splits of any store."""
    path = _written_bam(spark, sf, False)
    good, bad = (binary.read_bam(spark, f"{path}/{folder}").withColumn("verdict", F.lit(verdict)) for folder, verdict in (("good", "accept"), ("bad", "reject")))
    return good.unionByName(bad).drop("file", "record")


@query("bam_regions", BAM_SQL + " SELECT name, chrom, \"start\", cigar FROM rd WHERE verdict = 'accept' AND (chrom = 'chr1' AND \"start\" < 90000 AND stop > 20000 OR chrom = 'chr4')")
def bam_regions(spark, sf):
    """Reads over regions of sorted files, through their indexes."""
    path = _written_bam(spark, sf, True)
    found = spark.read.format("bam").option("regions", "chr1:20000-90000,chr4").load(binary.files_below(f"{path}/good"))
    return found.select("name", "chrom", "start", "cigar")


# --- tracks -----------------------------------------------------------------------------------------

#: Scores of splice sites by their place, in 128ths, of every second place.
SITE_SQL = INTRON_TABLE + """,
st AS (SELECT DISTINCT chrom, strand, site, pos FROM (SELECT chrom, strand, 'donor' AS site, CASE WHEN strand = '-' THEN 100000000000 - s ELSE s - 1 END AS pos FROM introns UNION ALL SELECT chrom, strand, 'acceptor', CASE WHEN strand = '-' THEN 100000000000 - e - 1 ELSE e END FROM introns) WHERE pos % 2 = 0),
sv AS (SELECT *, CAST(pos * 31 % 100 AS DOUBLE) / 128 AS score FROM st)"""


def site_scores(spark, sf: str) -> DataFrame:
    """(chrom, strand, site, pos, score) of splice sites."""
    rows = fixtures.transcripts(spark, sf).select("chrom", "strand", F.explode("introns").alias("i"))
    donor, acceptor = classify.splice_positions(F.col("strand"), F.col("i.start"), F.col("i.end"))
    places = rows.select("chrom", "strand", F.explode(F.array(F.struct(F.lit("donor").alias("site"), donor.alias("pos")), F.struct(F.lit("acceptor").alias("site"), acceptor.alias("pos")))).alias("x")).select("chrom", "strand", "x.*")
    return places.where("pos % 2 = 0").distinct().withColumn("score", (F.col("pos") * 31 % 100).cast("double") / 128)


def site_tracks(spark, sf: str) -> DataFrame:
    """The scores, through bigWig files by site and strand."""
    binary.register(spark)
    scores, path, out = site_scores(spark, sf), new_folder(spark, "tracks"), None
    sizes = _sizes(scores.withColumn("end", F.col("pos") + 1))
    for site in ("donor", "acceptor"):
        binary.write_bigwig(scores.where(F.col("site") == site).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "score", "strand"), f"{path}/{site}", sizes)
        for folder, strand in (("plus", "+"), ("minus", "-")):
            files = binary.files_below(f"{path}/{site}/{folder}")
            if files:
                back = spark.read.format("bigwig").load(files).select("chrom", F.lit(strand).alias("strand"), F.lit(site).alias("site"), "pos", F.col("score").cast("double").alias("score"))
                out = back if out is None else out.unionByName(back)
    return scores.limit(0) if out is None else out


@query("bigwig_signal", SITE_SQL + " SELECT chrom, strand, site, pos, score FROM sv WHERE score >= 0.01")
def bigwig_signal(spark, sf):
    return site_tracks(spark, sf)


@query("splice_score_tracks", SITE_SQL + """ SELECT t0.comp, t0.s AS istart, t0.e AS iend, coalesce(d.score, 0) AS ai_donor, coalesce(a.score, 0) AS ai_acceptor FROM t0
 LEFT JOIN sv d ON d.chrom = t0.chrom AND d.strand = t0.strand AND d.site = 'donor' AND d.score >= 0.01 AND d.pos = CASE WHEN t0.strand = '-' THEN 100000000000 - t0.s ELSE t0.s - 1 END
 LEFT JOIN sv a ON a.chrom = t0.chrom AND a.strand = t0.strand AND a.site = 'acceptor' AND a.score >= 0.01 AND a.pos = CASE WHEN t0.strand = '-' THEN 100000000000 - t0.e - 1 ELSE t0.e END""")
def splice_score_tracks(spark, sf):
    """Introns meet the scores of their sites, which come from bigWig files."""
    table = classify.intron_table(_packed_once(spark, sf, Mode.INTRON))
    return classify.with_splice_scores(table, site_tracks(spark, sf)).select("comp", "istart", "iend", "ai_donor", "ai_acceptor")


# --- records ----------------------------------------------------------------------------------------


@query("fastq_records", BASE + " SELECT row_number() OVER (ORDER BY k) - 1 AS record, concat('q', k) AS name, repeat('ACGT', CAST(k % 5 + 1 AS INT)) AS seq, repeat('IIII', CAST(k % 5 + 1 AS INT)) AS quality FROM tx")
def fastq_records(spark, sf):
    """Records over several files, numbered in file order."""
    k, path = F.col("k"), new_folder(spark, "reads")
    many = lambda x: F.repeat(F.lit(x), (k % 5 + 1).cast("int"))
    rows = fixtures.transcripts(spark, sf).repartitionByRange(6, "k").sortWithinPartitions("k")
    rows.select(F.concat_ws("\n", F.concat(F.lit("@q"), k), many("ACGT"), F.lit("+"), many("IIII")).alias("value")).write.text(path)
    return sequences.read_fastq(spark, path)


# --- whole texts ------------------------------------------------------------------------------------


def _grown_sql(clips: int) -> str:
    """CTEs that end in gr (doc_id, tail): tails over 30 bases and the clip, doc_id % ``clips``, and 50 more while they fill it."""
    return TAIL_SQL + f""", n AS (SELECT doc_id, seq, length(seq) AS size, 30 + doc_id % {clips} AS first FROM b WHERE seq <> ''),
 p AS (SELECT doc_id, size, first, unnest(range(1, size + 1)) AS k, unnest(string_split(seq, '')) AS base FROM n),
 e AS (SELECT *, ln(0.5) + (k - 1) * ln(0.9) + sum(CASE WHEN base = 'A' THEN ln(0.99) ELSE ln((1 - 0.99) / 3) END) OVER (PARTITION BY doc_id ORDER BY k) - k * ln(0.25) AS filled FROM p),
 o AS (SELECT doc_id, size, first, k, filled, filled + ln(1 - 0.9) AS closed FROM e UNION ALL SELECT doc_id, size, first, 0, NULL, ln(0.5) FROM n),
 m AS (SELECT *, max(closed) OVER w AS best, arg_max(k, closed) OVER w AS at_best FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT doc_id, k, CASE WHEN filled > best THEN k ELSE at_best END AS tail FROM m WHERE k > 0 AND (k = size OR k >= first AND (k - first) % 50 = 0)),
 gr AS (SELECT b.doc_id, CAST(coalesce(min_by(tail, t.k) FILTER (WHERE tail < t.k), any_value(length(seq))) AS BIGINT) AS tail FROM b LEFT JOIN t ON t.doc_id = b.doc_id GROUP BY b.doc_id)"""


@query("polya_tail_growing", _grown_sql(7) + " SELECT doc_id, tail FROM gr")
def polya_tail_growing(spark, sf):
    return tails(spark, sf).select("doc_id", polya.growing_tail(F.col("seq"), (30 + F.col("doc_id") % 7).cast("int")).cast("long").alias("tail"))


@query("read_tails", _grown_sql(60) + " SELECT doc_id, doc_id % 60 AS polya_len, greatest(doc_id % 60, tail) AS polya_read_len FROM gr")
def read_tails(spark, sf):
    """Tails of reads that end in a clipped run of A, within the clip and beyond it."""
    reads = tails(spark, sf).select("doc_id", F.reverse("seq").alias("seq"), (F.col("doc_id") % 60).alias("three_clip"))
    return alignments.tails(reads).select("doc_id", "polya_len", "polya_read_len")


@query("kmer_rt_scan", TAIL_SQL + """, p AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS j, unnest(string_split(seq, '')) AS base, length(seq) AS n FROM b WHERE length(seq) >= 32),
 d AS (SELECT doc_id, j, n, strpos('ACGT', base) - 1 AS v FROM p),
 c AS (SELECT doc_id, j, n, """ + " + ".join(f"lead(v, {t}) OVER w * {4 ** (7 - t)}" for t in range(8)) + """ AS code FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
 x AS (SELECT doc_id, j, n, """ + ", ".join(f"coalesce(bit_count(xor(code, lead(code, {k}) OVER w)) <= 1, false) AS d{k}" for k in range(16, 25)) + """ FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
 y AS (SELECT doc_id, j, n, """ + ", ".join("(" + " OR ".join(f"d{20 + y - a}" for y in range(5)) + f") AS m{a}" for a in range(5)) + """ FROM x),
 z AS (SELECT doc_id, j, n, m0 OR """ + " OR ".join(f"coalesce(lead(m{a}, {a}) OVER w, false)" for a in range(1, 5)) + """ AS hit FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY j))
 SELECT doc_id, count(*) AS n_sites, count(*) FILTER (WHERE hit) AS n_rt FROM z WHERE j <= n - 31 GROUP BY doc_id""")
def kmer_rt_scan(spark, sf):
    """Places of a whole text whose 12 bases repeat, as at a template switch, 20 bases on."""
    t = dna.with_rt_sites(tails(spark, sf).where("length(seq) >= 32"))
    return t.select("doc_id", (F.length("seq") - 31).cast("long").alias("n_sites"), F.size("rt_sites").cast("long").alias("n_rt"))


_SHARE = lambda c, table: f"CASE {c} " + " ".join(f"WHEN '{b}' THEN {v}::DOUBLE" for b, v in table.items()) + " END"


@query("maxent_consensus", TAIL_SQL + f""", p AS (SELECT doc_id, unnest(range(1, length(seq) - 21)) AS i, seq FROM b WHERE length(seq) >= 23),
 w AS (SELECT doc_id, substring(seq, i + 18, 1) AS x, substring(seq, i + 19, 1) AS y FROM p)
 SELECT doc_id, count(*) AS n, max(({_SHARE('x', classify.config.CONS1)} * {_SHARE('y', classify.config.CONS2)}) / ({_SHARE('x', classify.config.BGD)} * {_SHARE('y', classify.config.BGD)})) AS score FROM w GROUP BY doc_id""")
def maxent_consensus(spark, sf):
    """The best acceptor consensus of all 23-mers of a text."""
    t = dna.with_consensus_scores(tails(spark, sf).where("length(seq) >= 23"))
    return t.select("doc_id", F.size("consensus_scores").cast("long").alias("n"), F.array_max("consensus_scores").alias("score"))
