"""Registered queries of the engine and, for each, SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import config
from strandloom.functions import coords, dna
from strandloom.operators import alignments, classify, components, cutsites, descriptor, fusion, intervals, nmd, polya, retention, truncation
from strandloom.operators.components import Mode, Overlap
from strandloom.plans import fixtures
from strandloom.plans.fixtures import EXONS_SQL, transcripts
from strandloom.sources import sequences, text
from strandloom.workspace import materialize, shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BASE = "WITH RECURSIVE" + EXONS_SQL


def clusters_sql(source: str) -> str:
    """CTEs that end in comp (k, comp) for intervals of ``source`` (k, chrom, strand, s, e)."""
    return f"""
isl1 AS (SELECT k, chrom, strand, s, e, CASE WHEN s < max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM {source}),
isl AS (SELECT k, concat(chrom, strand, sum(o) OVER (PARTITION BY chrom, strand ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS g FROM isl1),
reach AS (SELECT DISTINCT k, k AS r FROM isl UNION SELECT b.k, reach.r FROM reach JOIN isl a ON a.k = reach.k JOIN isl b ON b.g = a.g),
comp AS MATERIALIZED (SELECT k, min(r) AS comp FROM reach GROUP BY k),
packed AS MATERIALIZED (SELECT tx.*, comp, count(*) FILTER (WHERE is_ref) OVER (PARTITION BY comp) AS n_refs, count(*) FILTER (WHERE NOT is_ref) OVER (PARTITION BY comp) AS n_queries FROM tx JOIN comp USING (k))"""


EXON_PACK = BASE + "," + clusters_sql("exons")
QUERY_PACK = EXON_PACK + ", pk AS (SELECT * FROM packed WHERE n_refs > 0 AND n_queries > 0)"
REF_PACK = EXON_PACK + ", pk AS (SELECT * FROM packed WHERE n_refs > 0)"
CDS_EXONS = ", cdsx AS (SELECT DISTINCT k, chrom, strand, greatest(s, cs) AS s, least(e, ce) AS e FROM exons JOIN (SELECT k, cs, ce FROM tx) USING (k) WHERE e >= cs AND s <= ce)"
BOUND_EXONS = """, bndx AS (SELECT k, chrom, strand, CASE WHEN s < cs AND e < ce THEN cs ELSE s END AS s, CASE WHEN s > cs AND e > ce THEN ce ELSE e END AS e
  FROM exons JOIN (SELECT k, cs, ce FROM tx) USING (k) WHERE e >= cs AND s <= ce)"""
#: Intron table of components with a reference, and the fixture's scores for it.
INTRON_TABLE = REF_PACK + """,
ir AS (SELECT i.*, comp FROM introns i JOIN pk USING (k)),
t0 AS (SELECT comp, chrom, strand, s, e, count(*) FILTER (WHERE NOT is_ref) AS seen, bool_or(is_ref) AS is_toga FROM ir GROUP BY ALL),
hull AS (SELECT comp, min(cs) AS h0, max(ce) AS h1 FROM pk WHERE is_ref GROUP BY comp),
sp AS (SELECT t0.comp, s, e, count(*) AS spanned FROM t0 JOIN pk ON pk.comp = t0.comp AND NOT pk.is_ref AND tstart <= s AND e <= tend WHERE seen > 0 GROUP BY ALL),
it AS (SELECT t0.*, coalesce(spanned, 0) AS spanned,
  CASE WHEN is_toga OR (h0 < s AND e < h1) THEN 'CDS' WHEN s > h1 OR e < h0 THEN 'UTR' WHEN (s < h0 AND e < h1) OR (s < h1 AND e > h1) THEN 'Mixed' ELSE 'Unknown' END AS position,
  seen > 0 AND (e - s) % 3 = 0 AS in_frame FROM t0 JOIN hull USING (comp) LEFT JOIN sp USING (comp, s, e)),
ai AS (SELECT *, CAST((((CASE WHEN strand = '-' THEN 100000000000 - s ELSE s - 1 END) * 31) % 100) AS DOUBLE) / 1000 AS ai_donor,
  CAST((((CASE WHEN strand = '-' THEN 100000000000 - e - 1 ELSE e END) * 31) % 100) AS DOUBLE) / 1000 AS ai_acceptor,
  CAST((s * 17) % 40 AS DOUBLE) / 10 AS me_donor, CAST((e * 17) % 40 AS DOUBLE) / 10 AS me_acceptor, s % 7 = 0 AS is_rt FROM it),
su AS (SELECT *, CASE WHEN is_rt AND is_toga THEN 'SPLICED' WHEN is_rt THEN 'RT' WHEN is_toga OR (ai_donor >= 0.01 AND ai_acceptor >= 0.01 AND s % 3 = 0) THEN 'SPLICED' ELSE
  CASE WHEN spanned > 0 AND CAST(seen AS DOUBLE) / spanned >= 0.5 THEN 'SPLICED' WHEN me_donor >= 1.5 AND me_acceptor >= 1.5 AND ai_donor > 0 AND ai_acceptor > 0 AND s % 3 = 0 THEN 'SPLICED' ELSE 'UNCLEAR' END END AS support FROM ai)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _text(c: str):
    return coords.text(F.col(c))


def _packed(spark, sf: str, mode: Mode = Mode.DEFAULT, overlap: Overlap = Overlap.EXON) -> DataFrame:
    return components.pack(transcripts(spark, sf), overlap, mode)


def _packed_once(spark, sf: str, mode: Mode = Mode.DEFAULT, overlap: Overlap = Overlap.EXON) -> DataFrame:
    """The packed transcripts, written once for all uses in a query."""
    return materialize(_packed(spark, sf, mode, overlap), "packed")


# --- coordinates ------------------------------------------------------------------------------------

LIST = "string_agg(concat(s, '-', e), ',' ORDER BY s, e)"


@query("bed12_blocks", BASE + f"SELECT k, count(*) AS n_exons, {LIST} AS exons, CAST(sum(e - s) AS BIGINT) AS exon_len FROM exons GROUP BY k")
def bed12_blocks(spark, sf):
    return transcripts(spark, sf).select("k", F.size("exons").cast("long").alias("n_exons"), _text("exons").alias("exons"), "exon_len")


@query("oriented_coords", BASE + 'SELECT k, chrom, strand, tstart AS "start", tend AS "end", cs AS cds_start, ce AS cds_end FROM tx')
def oriented_coords(spark, sf):
    return transcripts(spark, sf).select("k", "chrom", "strand", "start", "end", "cds_start", "cds_end")


@query("introns", BASE + f"SELECT k, count(s) AS n_introns, coalesce({LIST}, '') AS introns FROM tx LEFT JOIN (SELECT k, s, e FROM introns) USING (k) GROUP BY k".replace("string_agg(", "string_agg(CASE WHEN s IS NOT NULL THEN ").replace(", ',' ORDER", " END, ',' ORDER"))
def introns(spark, sf):
    return transcripts(spark, sf).select("k", F.size("introns").cast("long").alias("n_introns"), _text("introns").alias("introns"))


@query("cds_clip", BASE + CDS_EXONS + f" SELECT k, {LIST} AS cds_exons FROM cdsx GROUP BY k")
def cds_clip(spark, sf):
    return transcripts(spark, sf).select("k", coords.text(coords.clip_cds(F.col("exons"), F.col("cds_start"), F.col("cds_end"))).alias("cds_exons")).where("cds_exons <> ''")


@query("first_exon", BASE + "SELECT k, min(s) AS s, min_by(e, s) AS e FROM exons GROUP BY k")
def first_exon(spark, sf):
    return transcripts(spark, sf).select("k", coords.first_exon(F.col("exons")).alias("x")).select("k", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query("middle_exons", BASE + f", m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e) AS r FROM exons) SELECT k, {LIST} AS middles FROM m WHERE r > 1 GROUP BY k")
def middle_exons(spark, sf):
    return transcripts(spark, sf).select("k", coords.text(coords.middle_exons(F.col("exons"))).alias("middles")).where("middles <> ''")


@query("utr_bounds", BASE + "SELECT k, tstart AS five_start, cs AS five_end, ce AS three_start, tend AS three_end FROM tx")
def utr_bounds(spark, sf):
    bounds = coords.utr_bounds(*(F.col(c) for c in ("start", "end", "cds_start", "cds_end")))
    return transcripts(spark, sf).select("k", bounds.alias("u")).select("k", "u.*")


@query("gene_token", BASE + "SELECT k, concat('G', k - k % 40) AS gene FROM tx WHERE is_ref")
def gene_token(spark, sf):
    return transcripts(spark, sf).where("is_ref").select("k", coords.gene_token(F.col("name")).alias("gene"))


TAGS = "k % 5 AS fc, k % 3 AS tc, k % 60 AS pa, CASE WHEN k % 4 = 0 THEN k % 60 ELSE k % 60 + k % 3 + k % 9 END AS pr, 980 + k % 20 AS iy"


@query("read_tags", BASE + f"SELECT k, {TAGS} FROM tx WHERE NOT is_ref")
def read_tags(spark, sf):
    t = transcripts(spark, sf).where("not is_ref").withColumn("t", coords.read_tags(F.col("name")))
    return t.select("k", *(F.col("t")[x.upper()].alias(x) for x in ("fc", "tc", "pa", "pr", "iy")))


@query("location_text", BASE + "SELECT k, concat(chrom, ':', ps, '-', pe) AS location FROM tx JOIN (SELECT k, ps, pe FROM pc) USING (k)")
def location_text(spark, sf):
    return transcripts(spark, sf).select("k", coords.location(F.col("chrom"), F.col("strand"), F.col("start"), F.col("end")).alias("location"))


@query("orf_to_genome", BASE + """, w AS (SELECT *, sum(e - s) OVER (PARTITION BY k ORDER BY s, e) - (e - s) AS before FROM exons),
 loc AS (SELECT tx.k, tx.strand, (SELECT min(s + p - before) FROM w WHERE w.k = tx.k AND before <= p AND p < before + e - s) AS g, p, tend FROM tx, (VALUES (10), (200)) v(p))
 SELECT k, min(CASE WHEN strand = '-' THEN 100000000000 - coalesce(g, tend) ELSE coalesce(g, tend) END) AS cds_start, max(CASE WHEN strand = '-' THEN 100000000000 - coalesce(g, tend) ELSE coalesce(g, tend) END) AS cds_end FROM loc GROUP BY k""")
def orf_to_genome(spark, sf):
    a, b = coords.orf_to_cds(F.col("exons"), F.col("strand"), F.lit(10), F.lit(200))
    return transcripts(spark, sf).select("k", a.alias("cds_start"), b.alias("cds_end"))


# --- components -------------------------------------------------------------------------------------


def _clusters(name: str, overlap: Overlap, sql: str):
    @query(name, sql + " SELECT k, comp FROM comp")
    def run(spark, sf):
        return components.components(transcripts(spark, sf), overlap).select("k", "comp")


_clusters("clusters_exon", Overlap.EXON, EXON_PACK)
_clusters("clusters_cds", Overlap.CDS, BASE + CDS_EXONS + "," + clusters_sql("cdsx"))
_clusters("clusters_cdsbound", Overlap.CDS_BOUND, BASE + BOUND_EXONS + "," + clusters_sql("bndx"))
_clusters("clusters_boundary", Overlap.BOUNDARY, BASE + ", txb AS (SELECT k, chrom, strand, tstart AS s, tend AS e FROM tx)," + clusters_sql("txb"))


@query("component_sizes", EXON_PACK + " SELECT comp, min(n_refs) AS n_refs, min(n_queries) AS n_queries, count(*) AS n FROM packed GROUP BY comp")
def component_sizes(spark, sf):
    return _packed(spark, sf).groupBy("comp").agg(F.min("n_refs").alias("n_refs"), F.min("n_queries").alias("n_queries"), F.count("*").alias("n"))


@query("pack_mode_query", QUERY_PACK + " SELECT k, comp, n_refs, n_queries FROM pk")
def pack_mode_query(spark, sf):
    return _packed(spark, sf, Mode.QUERY).select("k", "comp", "n_refs", "n_queries")


@query("pack_mode_intron", REF_PACK + " SELECT k, comp, n_refs, n_queries FROM pk")
def pack_mode_intron(spark, sf):
    return _packed(spark, sf, Mode.INTRON).select("k", "comp", "n_refs", "n_queries")


@query("exon_overlap_pairs", BASE + "SELECT DISTINCT a.k AS a, b.k AS b FROM exons a JOIN exons b ON a.chrom = b.chrom AND a.strand = b.strand AND a.k < b.k AND a.s < b.e AND b.s < a.e")
def exon_overlap_pairs(spark, sf):
    from strandloom.operators.intervals import overlap_join

    x = materialize(transcripts(spark, sf).select("k", "chrom", "strand", F.explode("exons").alias("x")).select("k", "chrom", "strand", "x.start", "x.end"), "exons")
    return overlap_join(x, x, ["chrom", "strand"]).where("k < r_k").select(F.col("k").alias("a"), F.col("r_k").alias("b")).distinct()


@query("shared_introns", BASE + "SELECT DISTINCT a.k AS a, b.k AS b FROM introns a JOIN introns b ON a.chrom = b.chrom AND a.strand = b.strand AND a.k < b.k AND a.s = b.s AND a.e = b.e")
def shared_introns(spark, sf):
    x = transcripts(spark, sf).select("k", "chrom", "strand", F.explode("introns").alias("i"))
    return intervals.sharing(x, "k", ["chrom", "strand", "i"])


@query("shared_splice_sites", BASE + ", st AS (SELECT DISTINCT k, chrom, strand, unnest([s, e]) AS p FROM introns) SELECT DISTINCT a.k AS a, b.k AS b FROM st a JOIN st b ON a.chrom = b.chrom AND a.strand = b.strand AND a.k < b.k AND a.p = b.p")
def shared_splice_sites(spark, sf):
    x = transcripts(spark, sf).select("k", "chrom", "strand", F.explode(F.flatten(F.transform("introns", lambda i: F.array(i["start"], i["end"])))).alias("p"))
    return intervals.sharing(x, "k", ["chrom", "strand", "p"])


# --- introns ----------------------------------------------------------------------------------------


def scored_introns(packed: DataFrame) -> DataFrame:
    """The intron table with the fixture's scores and support."""
    s, e = F.col("istart"), F.col("iend")
    donor, acceptor = classify.splice_positions(F.col("strand"), s, e)
    ai = lambda p: (p * 31 % 100).cast("double") / 1000
    t = classify.intron_table(packed).withColumns({"ai_donor": ai(donor), "ai_acceptor": ai(acceptor), "me_donor": (s * 17 % 40).cast("double") / 10, "me_acceptor": (e * 17 % 40).cast("double") / 10, "is_rt": s % 7 == 0})
    known = lambda c: F.when(s % 3 == 0, F.col(c)).otherwise(0.0)
    return t.withColumns({"ai_donor": known("ai_donor"), "ai_acceptor": known("ai_acceptor")}).withColumn("support", classify.support())


@query("intron_seen", INTRON_TABLE + " SELECT comp, s AS istart, e AS iend, seen, spanned FROM it")
def intron_seen(spark, sf):
    return classify.intron_table(_packed_once(spark, sf, Mode.INTRON)).select("comp", "istart", "iend", "seen", "spanned")


@query("intron_position", INTRON_TABLE + " SELECT comp, s AS istart, e AS iend, position, is_toga, in_frame FROM it")
def intron_position(spark, sf):
    return classify.intron_table(_packed_once(spark, sf, Mode.INTRON)).select("comp", "istart", "iend", "position", "is_toga", "in_frame")


@query("toga_union", INTRON_TABLE + " SELECT position, is_toga, seen > 0 AS observed, count(*) AS n FROM it GROUP BY ALL")
def toga_union(spark, sf):
    return classify.intron_table(_packed_once(spark, sf, Mode.INTRON)).groupBy("position", "is_toga", (F.col("seen") > 0).alias("observed")).agg(F.count("*").alias("n"))


@query("intron_support", INTRON_TABLE + " SELECT comp, s AS istart, e AS iend, support FROM su")
def intron_support(spark, sf):
    return scored_introns(_packed_once(spark, sf, Mode.INTRON)).select("comp", "istart", "iend", "support")


RETAINED = INTRON_TABLE + """,
sw AS MATERIALIZED (SELECT *, concat(chrom, ':', CASE WHEN strand = '-' THEN 100000000000 - e ELSE s END, '-', CASE WHEN strand = '-' THEN 100000000000 - s ELSE e END) AS w, count(*) OVER (PARTITION BY comp) AS ref_size, CASE WHEN s % 3 = 0 THEN ai_donor ELSE 0 END AS don, CASE WHEN s % 3 = 0 THEN ai_acceptor ELSE 0 END AS acc FROM su),
rd AS MATERIALIZED (SELECT k, pk.comp, chrom, strand, ref_size, count(*) OVER (PARTITION BY pk.comp) AS query_size FROM pk JOIN (SELECT DISTINCT comp, ref_size FROM sw) USING (comp) WHERE NOT is_ref),
hit AS MATERIALIZED (SELECT rd.k, sw.* FROM rd JOIN exons x ON x.k = rd.k JOIN sw ON sw.comp = rd.comp AND x.s < sw.s AND sw.e < x.e),
own AS MATERIALIZED (SELECT rd.k, string_agg(w, ',' ORDER BY sw.s, sw.e) AS has_map FROM rd JOIN introns i ON i.k = rd.k JOIN sw ON sw.comp = rd.comp AND sw.s = i.s AND sw.e = i.e AND sw.support = 'RT' GROUP BY rd.k),
vv AS (SELECT k, count(*) FILTER (WHERE support <> 'RT') AS n, max(CASE WHEN support = 'RT' THEN 0 WHEN position = 'CDS' AND NOT in_frame THEN CASE support WHEN 'UNCLEAR' THEN 1 ELSE 2 END WHEN position = 'Unknown' THEN CASE WHEN in_frame THEN 1 ELSE 2 END ELSE 0 END) AS worst,
  coalesce(bool_or(support = 'RT'), false) AS rt, string_agg(w, ',' ORDER BY s, e) FILTER (WHERE support = 'RT') AS rt_map, string_agg(w, ',' ORDER BY s, e) FILTER (WHERE support <> 'RT') AS coords, string_agg(support, ',' ORDER BY s, e) FILTER (WHERE support <> 'RT') AS types,
  string_agg(position, ',' ORDER BY s, e) FILTER (WHERE support <> 'RT') AS places, string_agg(in_frame::VARCHAR, ',' ORDER BY s, e) FILTER (WHERE support <> 'RT') AS frames, string_agg(CAST(round(don * 1000) AS BIGINT)::VARCHAR, ',' ORDER BY s, e) FILTER (WHERE support <> 'RT') AS donors,
  string_agg(CAST(round(acc * 1000) AS BIGINT)::VARCHAR, ',' ORDER BY s, e) FILTER (WHERE support <> 'RT') AS acceptors FROM hit GROUP BY k),
ve AS (SELECT rd.*, coalesce(n, 0) AS number_of_retentions, coalesce(rt, false) AS retains_rt_intron, k IN (SELECT k FROM own) AS has_rt_intron, CASE worst WHEN 2 THEN 'DISCARD' WHEN 1 THEN 'UNCLEAR' ELSE 'KEEP' END AS exonic_status, rt_map, coords, types, places, frames, donors, acceptors FROM rd LEFT JOIN vv USING (k)),
vr AS MATERIALIZED (SELECT *, CAST(avg(CASE WHEN number_of_retentions > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY comp) AS FLOAT) AS ratio FROM ve)"""


def _retention(spark, sf, recover: bool = False):
    packed = _packed_once(spark, sf, Mode.INTRON)
    return retention.verdicts(packed.where("not is_ref"), scored_introns(packed), recover=recover)


@query("retention_hits", RETAINED + " SELECT k, s AS istart, e AS iend, support FROM hit")
def retention_hits(spark, sf):
    packed = _packed_once(spark, sf, Mode.INTRON)
    return retention.retained(packed.where("not is_ref"), scored_introns(packed)).select("k", "istart", "iend", "support")


@query("rt_reads", RETAINED + " SELECT k FROM own")
def rt_reads(spark, sf):
    packed = _packed_once(spark, sf, Mode.INTRON)
    return retention.rt_hits(packed.where("not is_ref"), scored_introns(packed)).select("k").distinct()


@query("retention_verdict", RETAINED + """ SELECT k, comp, number_of_retentions, number_of_retentions > 0 AS intron_retention, retains_rt_intron, has_rt_intron, exonic_status, CASE WHEN has_rt_intron THEN 'DISCARD' ELSE 'KEEP' END AS intronic_status, ref_size, query_size, CAST(ratio AS DOUBLE) AS ratio,
 CASE WHEN exonic_status = 'DISCARD' OR has_rt_intron THEN 'discard' ELSE 'keep' END AS category, coalesce(coords, '') AS coords_of_retention, coalesce(types, '') AS retention_support_type, coalesce(places, '') AS location_of_retention, coalesce(frames, '') AS is_intron_retained_in_frame,
 coalesce(donors, '') AS retention_donor_score, coalesce(acceptors, '') AS retention_acceptor_score, coalesce(rt_map, '') AS retains_rt_intron_map, coalesce(has_map, '') AS has_rt_intron_map FROM vr LEFT JOIN own USING (k)""")
def retention_verdict(spark, sf):
    """All columns; arrays as text, scores in thousandths."""
    v = _retention(spark, sf)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    score = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias(c)
    arrays = ("coords_of_retention", "retention_support_type", "location_of_retention", "is_intron_retained_in_frame", "retains_rt_intron_map", "has_rt_intron_map")
    plain = [F.col("ratio").cast("double").alias("ratio") if c == "ratio" else c for c in v.columns if c not in arrays and not c.endswith("_score")]
    return v.select(*plain, *map(text, arrays), score("retention_donor_score"), score("retention_acceptor_score"))


@query("retention_review", RETAINED + " SELECT k, CAST(ratio AS DOUBLE) AS ratio, CASE WHEN ratio > 0.001 THEN 'review' WHEN exonic_status = 'DISCARD' OR has_rt_intron THEN 'discard' ELSE 'keep' END AS category FROM vr")
def retention_review(spark, sf):
    return _retention(spark, sf, True).select("k", F.col("ratio").cast("double").alias("ratio"), "category")


# --- nonsense-mediated decay ------------------------------------------------------------------------


@query("nmd_class", BASE + """, x AS (SELECT e.k, e.s, e.e, cs, ce, row_number() OVER w AS i, count(*) OVER (PARTITION BY e.k) AS n FROM exons e JOIN (SELECT k, cs, ce FROM tx) USING (k) WHERE cs <> ce WINDOW w AS (PARTITION BY e.k ORDER BY s, e)),
 u AS (SELECT *, e >= ce AS a, row_number() OVER (PARTITION BY k, e >= ce ORDER BY i) AS j FROM x),
 l AS (SELECT *, sum(CASE WHEN NOT a THEN 0 WHEN j = 1 THEN e - ce ELSE e - s END) OVER (PARTITION BY k ORDER BY i) AS len FROM u),
 d AS (SELECT k, count(*) FILTER (WHERE a AND len >= 55) - 1 AS nmd_count, coalesce(min_by(e - ce, i) FILTER (WHERE a AND e - ce > 0), 0) AS dist, coalesce(max(len - (e - s)) FILTER (WHERE a AND i = n), 0) AS bp,
  CAST(sum(CASE WHEN e < cs OR s > ce THEN 0 WHEN e >= cs AND cs >= s THEN least(e, ce) - cs WHEN s > cs AND e < ce THEN e - s WHEN s > cs AND e >= ce THEN ce - s ELSE 0 END) AS BIGINT) AS cds_len FROM l GROUP BY k)
 SELECT k, nmd_count, CAST(dist AS BIGINT) AS dist_stop_to_next_sj, cds_len, CAST(bp AS BIGINT) AS bp_utr_to_last_ejc, CASE WHEN nmd_count <= 0 THEN 'NN' WHEN bp <= 80 OR dist >= 400 OR cds_len <= 100 THEN concat('WN', nmd_count) ELSE concat('SN', nmd_count) END AS nmd FROM d""")
def nmd_class(spark, sf):
    return nmd.classify_nmd(transcripts(spark, sf)).select("k", "nmd_count", "dist_stop_to_next_sj", "cds_len", "bp_utr_to_last_ejc", "nmd")


# --- fusion: each reference is cut in two genes at the fourth exon -----------------------------------------------

FUSION = BASE + """,
fx AS (SELECT CASE WHEN is_ref THEN k * 2 + (n >= 4)::INT ELSE k * 2 END AS k, chrom, strand, is_ref, s, e, CASE WHEN is_ref THEN concat('G', k - k % 40, CASE WHEN n >= 4 THEN 'B' ELSE 'A' END) END AS gene FROM exons),
fi AS (SELECT k, is_ref, gene, e + 1 AS s, ns - 1 AS e FROM (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s, e) AS ns FROM fx) WHERE e + 1 < ns - 1),""" + clusters_sql("fx").replace("packed AS MATERIALIZED (SELECT tx.*", "unused AS (SELECT tx.*") + """,
refx AS (SELECT * FROM fx WHERE is_ref), r1 AS (SELECT k, chrom, strand, s, e, CASE WHEN s < max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM refx),
r2 AS (SELECT k, concat(chrom, strand, sum(o) OVER (PARTITION BY chrom, strand ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS g FROM r1),
r3 AS (SELECT DISTINCT k, k AS r FROM r2 UNION SELECT b.k, r3.r FROM r3 JOIN r2 a ON a.k = r3.k JOIN r2 b ON b.g = a.g),
rc AS (SELECT k, min(r) AS rcomp FROM r3 GROUP BY k),
gl AS (SELECT rcomp, string_agg(DISTINCT gene, '.' ORDER BY gene) AS locus FROM rc JOIN (SELECT DISTINCT k, gene FROM refx) USING (k) GROUP BY rcomp),
lo AS (SELECT k, locus FROM rc JOIN gl USING (rcomp)),
cl AS (SELECT comp, count(DISTINCT locus) AS comp_loci FROM comp JOIN lo USING (k) GROUP BY comp),
qx AS (SELECT DISTINCT k FROM fx WHERE NOT is_ref),
tl AS (SELECT q.k, count(DISTINCT locus) AS n_loci FROM fx q JOIN comp cq ON cq.k = q.k JOIN comp c ON c.comp = cq.comp JOIN refx r ON r.k = c.k JOIN lo ON lo.k = r.k WHERE NOT q.is_ref AND q.s < r.e AND r.s < q.e GROUP BY q.k),
ps AS (SELECT DISTINCT k, is_ref, unnest([s, e]) AS p FROM fi),
sl AS (SELECT q.k, count(DISTINCT locus) AS n_spliced FROM ps q JOIN comp cq ON cq.k = q.k JOIN comp c ON c.comp = cq.comp JOIN ps r ON r.k = c.k AND r.is_ref AND r.p = q.p JOIN lo ON lo.k = r.k WHERE NOT q.is_ref GROUP BY q.k),
fv AS (SELECT k, comp, coalesce(n_loci, 0) AS n_loci, coalesce(n_spliced, 0) AS n_spliced, CASE WHEN coalesce(comp_loci, 0) > 1 AND coalesce(n_loci, 0) > 1 THEN CASE WHEN coalesce(n_spliced, 0) > 1 THEN 'real' ELSE 'fake' END ELSE 'none' END AS kind
 FROM qx JOIN comp USING (k) LEFT JOIN cl USING (comp) LEFT JOIN tl USING (k) LEFT JOIN sl USING (k)),
fr AS (SELECT *, CAST(avg(CASE kind WHEN 'real' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY comp) AS FLOAT) AS real_ratio, CAST(avg(CASE kind WHEN 'fake' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY comp) AS FLOAT) AS fake_ratio FROM fv)"""


def fusion_fixture(spark, sf) -> DataFrame:
    """Transcripts with gene; each reference is cut in two at its fourth line number."""
    x = fixtures.exon_rows(spark, sf)
    s, e = coords.mirrored(F.col("strand"), F.col("s"), F.col("e"))
    key = F.when(F.col("is_ref"), F.col("k") * 2 + (F.col("n") >= 4).cast("int")).otherwise(F.col("k") * 2)
    gene = F.when(F.col("is_ref"), F.concat(F.lit("G"), F.col("k") - F.col("k") % 40, F.when(F.col("n") >= 4, "B").otherwise("A")))
    g = x.withColumns({"_k": key, "gene": gene, "_s": s, "_e": e}).groupBy(F.col("_k").alias("k"), "chrom", "strand", "is_ref", "gene").agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end")))).alias("exons"))
    return g.withColumns({"introns": coords.introns(F.col("exons")), "start": F.col("exons")[0]["start"], "end": F.array_max(F.transform("exons", lambda v: v["end"]))}).withColumns({"cds_start": F.col("start") + 30, "cds_end": F.col("end"), "name": F.concat_ws(".", F.lit("TX"), "gene", "k")})


def fusion_packed(spark, sf) -> DataFrame:
    tx = fusion_fixture(spark, sf)
    refs = tx.where("is_ref")
    loci = fusion.reference_loci(refs.select("k", "gene").join(components.components(refs), "k")).select("k", "locus")
    return materialize(components.pack(tx, Overlap.EXON, Mode.DEFAULT).join(loci, "k", "left"), "packed")


@query("ref_loci", FUSION + " SELECT k, locus FROM lo")
def ref_loci(spark, sf):
    refs = fusion_fixture(spark, sf).where("is_ref")
    return fusion.reference_loci(refs.select("k", "gene").join(components.components(refs), "k")).select("k", "locus")


@query("fusion_verdict", FUSION + " SELECT k, comp, n_loci, n_spliced, kind FROM fr")
def fusion_verdict(spark, sf):
    return fusion.verdicts(fusion_packed(spark, sf)).select("k", "comp", "n_loci", "n_spliced", "kind")


@query("fusion_ratios", FUSION + " SELECT k, CAST(real_ratio AS DOUBLE) AS real_ratio, CAST(fake_ratio AS DOUBLE) AS fake_ratio FROM fr")
def fusion_ratios(spark, sf):
    return fusion.verdicts(fusion_packed(spark, sf)).select("k", *(F.col(c).cast("double").alias(c) for c in ("real_ratio", "fake_ratio")))


@query("fusion_review", FUSION + " SELECT k, CASE WHEN real_ratio >= 0.5 THEN 'review' WHEN kind = 'real' THEN 'fusions' WHEN kind = 'fake' THEN 'fakes' ELSE 'pass' END AS category FROM fr")
def fusion_review(spark, sf):
    return fusion.verdicts(fusion_packed(spark, sf), recover=True).select("k", "category")


# --- truncation -------------------------------------------------------------------------------------


TRUNCATION = EXON_PACK + """,
rf AS (SELECT comp, k, row_number() OVER (PARTITION BY comp ORDER BY tstart, tend DESC, concat('TX.G', k - k % 40, '.', k)) AS rn FROM packed WHERE is_ref),
xo AS (SELECT k, s, e, row_number() OVER (PARTITION BY k ORDER BY s, e) AS i FROM exons),
rx AS (SELECT comp, rn, min(s) FILTER (WHERE i = 1) AS fs, min(e) FILTER (WHERE i = 1) AS fe, coalesce(list({'s': s, 'e': e}) FILTER (WHERE i > 1), []) AS mids FROM rf JOIN xo USING (k) GROUP BY comp, rn),
fold AS (SELECT DISTINCT comp, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS starts, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS middles FROM packed
 UNION ALL SELECT fold.comp, rn, CASE WHEN len(list_filter(middles, lambda m: fs < m.e AND m.s < fe)) = 0 OR len(list_filter(starts, lambda q: fs >= q.s AND fs < q.e)) > 0 THEN list_append(starts, {'s': fs, 'e': fe}) ELSE starts END, list_concat(middles, mids)
 FROM fold JOIN rx ON rx.comp = fold.comp AND rx.rn = fold.r + 1),
st AS (SELECT comp, max_by(starts, r) AS starts, max_by(middles, r) AS middles FROM fold GROUP BY comp),
qf AS (SELECT packed.k, packed.comp, s AS fs, e AS fe, n_refs, n_queries FROM packed JOIN xo ON xo.k = packed.k AND i = 1 WHERE NOT is_ref),
qo AS (SELECT qf.*, len(list_filter(starts, lambda q: fs >= q.s AND fs < q.e)) > 0 AS complete, middles FROM qf JOIN st USING (comp)),
qw AS (SELECT *, list_sort(CASE WHEN complete THEN list_filter(middles, lambda m: fs >= m.s AND fs < m.e) ELSE list_filter(middles, lambda m: fs < m.e AND m.s < fe) END)[1] AS owner FROM qo),
qr AS (SELECT *, owner IS NOT NULL AS is_truncated, CAST(avg(CASE WHEN owner IS NOT NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY comp) AS FLOAT) AS ratio FROM qw)"""
RECOVERY = TRUNCATION + """,
ow AS (SELECT DISTINCT comp, owner.s AS os, owner.e AS oe FROM qr WHERE owner IS NOT NULL),
sup AS (SELECT comp, s AS os, e AS oe, count(*) AS c FROM packed JOIN (SELECT DISTINCT k, s, e FROM exons) USING (k) WHERE is_ref GROUP BY ALL),
ds AS (SELECT k, os * 1000 + (oe - os) AS o, CAST(CAST(coalesce(c, 0) AS DOUBLE) / n_refs AS FLOAT) AS sp FROM qr JOIN ow USING (comp) LEFT JOIN sup USING (comp, os, oe) WHERE is_truncated AND ratio >= 0.5 AND fs < oe AND os < fe),
dr AS (SELECT k, bool_or(sp < 0.5) AS released, CAST(coalesce(arg_min(sp, o) FILTER (WHERE sp < 0.5), arg_max(sp, o)) AS DOUBLE) AS support FROM ds GROUP BY k)"""


@query("truncation_verdict", TRUNCATION + " SELECT k, comp, is_truncated, NOT complete AS is_novel_start, n_refs AS ref_size, n_queries AS query_size, CAST(ratio AS DOUBLE) AS ratio, CASE WHEN is_truncated THEN 'truncated' ELSE 'pass' END AS category FROM qr")
def truncation_verdict(spark, sf):
    return truncation.verdicts(_packed_once(spark, sf)).select("k", "comp", "is_truncated", "is_novel_start", "ref_size", "query_size", F.col("ratio").cast("double").alias("ratio"), "category")


@query("truncation_recovery", RECOVERY + " SELECT k, comp, released IS NOT NULL AS is_dirty, coalesce(NOT released, false) AS is_supported, coalesce(support, 0) AS support_ratio, CASE WHEN is_truncated AND NOT coalesce(released, false) THEN 'truncated' ELSE 'pass' END AS category FROM qr LEFT JOIN dr USING (k)")
def truncation_recovery(spark, sf):
    return truncation.verdicts(_packed_once(spark, sf), recover=True).select("k", "comp", "is_dirty", "is_supported", F.col("support_ratio").cast("double").alias("support_ratio"), "category")


@query("exon_support", EXON_PACK + ", rx AS (SELECT comp, n_refs, s, e FROM packed JOIN (SELECT DISTINCT k, s, e FROM exons) USING (k) WHERE is_ref) SELECT comp, s, e, CAST(CAST(CAST(count(*) AS DOUBLE) / min(n_refs) AS FLOAT) AS DOUBLE) AS support FROM rx GROUP BY comp, s, e")
def exon_support(spark, sf):
    return truncation.owner_support(_packed_once(spark, sf)).select("comp", F.col("o.start").alias("s"), F.col("o.end").alias("e"), F.col("support").cast("double").alias("support"))


# --- poly-A -----------------------------------------------------------------------------------------


@query("polya_stats", BASE + f", t AS (SELECT k, {TAGS} FROM tx WHERE NOT is_ref) SELECT k, pr AS poly_a, tc AS clip, pa AS clipped_a, CASE WHEN pa = pr THEN 0 ELSE pr - (tc + pa) END AS gpa FROM t")
def polya_stats(spark, sf):
    return _polya_reads(transcripts(spark, sf).where("not is_ref")).select("k", "poly_a", "clip", "clipped_a", "gpa")


def _polya_reads(reads: DataFrame) -> DataFrame:
    t = reads.withColumn("t", coords.read_tags(F.col("name")))
    x = t.withColumns({"clip": F.col("t")["TC"], "clipped_a": F.col("t")["PA"], "poly_a": F.col("t")["PR"]}).drop("t")
    return x.withColumn("gpa", polya.genomic_polya(F.col("clipped_a"), F.col("poly_a"), F.col("clip")))


@query("polya_location", REF_PACK + " SELECT q.k, CASE WHEN bool_or(r.tstart < q.tend AND q.tend < r.tend) THEN 'CDS' ELSE 'UTR' END AS location FROM pk q JOIN pk r ON r.comp = q.comp AND r.is_ref WHERE NOT q.is_ref GROUP BY q.k")
def polya_location(spark, sf):
    p = _packed_once(spark, sf, Mode.POLYA)
    return polya.location_of_end(p.where("not is_ref"), p.where("is_ref")).select("k", "location")


@query("polya_filter", BASE + f", t AS (SELECT k, {TAGS} FROM tx WHERE NOT is_ref) SELECT k, pr AS poly_a FROM t WHERE pr >= 50")
def polya_filter(spark, sf):
    return polya.filter_tails(_polya_reads(transcripts(spark, sf).where("not is_ref"))).select("k", "poly_a")


@query("polya_scores", BASE + ", sc AS (SELECT chrom, CASE WHEN k % 2 = 1 THEN tend + 1 ELSE tend END AS pos, max(CAST(k % 100 AS DOUBLE) / 1000) AS score FROM tx WHERE k % 3 = 0 GROUP BY ALL) SELECT tx.k, coalesce(score, 0) AS score FROM tx LEFT JOIN sc ON sc.chrom = tx.chrom AND pos = CASE WHEN strand = '-' THEN tend + 1 ELSE tend END WHERE NOT is_ref")
def polya_scores(spark, sf):
    return polya.with_scores(transcripts(spark, sf).where("not is_ref"), score_track(spark, sf)).select("k", "score")


def score_track(spark, sf) -> DataFrame:
    tx = transcripts(spark, sf).where("k % 3 = 0")
    return tx.select("chrom", F.when(F.col("strand") == "-", F.col("end") + 1).otherwise(F.col("end")).alias("end"), ((F.col("k") % 100).cast("double") / 1000).alias("score"))


INTRAPRIMING = REF_PACK + f""",
lo AS (SELECT q.k, CASE WHEN bool_or(r.tstart < q.tend AND q.tend < r.tend) THEN 'CDS' ELSE 'UTR' END AS location FROM pk q JOIN pk r ON r.comp = q.comp AND r.is_ref WHERE NOT q.is_ref GROUP BY q.k),
sc AS (SELECT chrom, CASE WHEN k % 2 = 1 THEN tend + 1 ELSE tend END AS pos, max(CAST(k % 100 AS DOUBLE) / 1000) AS score FROM tx WHERE k % 3 = 0 GROUP BY ALL),
tg AS (SELECT k, {TAGS} FROM tx WHERE NOT is_ref),
ip AS MATERIALIZED (SELECT pk.k, comp, tend AS e, (CASE WHEN pa = pr THEN 0 ELSE pr - (tc + pa) END) < 5 OR pr >= 50 OR coalesce(score, 0) > 0.01 OR location = 'UTR' AS good, row_number() OVER (PARTITION BY comp ORDER BY tstart, tend DESC, concat('R', pk.k, '_'), pk.k) AS rn
 FROM pk JOIN lo USING (k) JOIN tg USING (k) LEFT JOIN sc ON sc.chrom = pk.chrom AND pos = CASE WHEN strand = '-' THEN tend + 1 ELSE tend END WHERE NOT is_ref),
one AS (SELECT DISTINCT comp, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[]) AS took FROM ip UNION ALL
 SELECT one.comp, rn, CASE WHEN good OR list_has_any(seen, [e, e - 2, e + 2]) THEN list_concat(seen, [e, e - 2, e + 2]) ELSE seen END, CASE WHEN good OR list_has_any(seen, [e, e - 2, e + 2]) THEN list_append(took, k) ELSE took END FROM one JOIN ip ON ip.comp = one.comp AND rn = r + 1),
o1 AS MATERIALIZED (SELECT comp, max_by(seen, r) AS seen, max_by(took, r) AS took FROM one GROUP BY comp),
rest AS MATERIALIZED (SELECT ip.comp, k, e, row_number() OVER (PARTITION BY ip.comp ORDER BY rn) AS rn FROM ip JOIN o1 USING (comp) WHERE NOT list_contains(took, k)),
two AS (SELECT comp, CAST(0 AS BIGINT) AS r, seen, CAST([] AS BIGINT[]) AS took FROM o1 UNION ALL
 SELECT two.comp, rn, CASE WHEN list_has_any(seen, [e, e - 2, e + 2]) THEN list_concat(seen, [e, e - 2, e + 2]) ELSE seen END, CASE WHEN list_has_any(seen, [e, e - 2, e + 2]) THEN list_append(took, k) ELSE took END FROM two JOIN rest ON rest.comp = two.comp AND rn = r + 1),
o2 AS (SELECT comp, max_by(took, r) AS took2 FROM two GROUP BY comp),
iq AS (SELECT k, ip.comp, list_contains(took, k) AS a, list_contains(took2, k) AS b FROM ip JOIN o1 USING (comp) JOIN o2 USING (comp)),
ir2 AS (SELECT *, CAST(avg(CASE WHEN a OR b THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY comp) AS FLOAT) AS ratio FROM iq)"""


@query("intrapriming", INTRAPRIMING + " SELECT k, comp, a AS is_supported, NOT (a OR b) AS is_intrapriming, b AS forced, CAST(ratio AS DOUBLE) AS ratio, CASE WHEN ratio > 0.5 THEN 'review' WHEN a OR b THEN 'pass' ELSE 'intrapriming' END AS category FROM ir2")
def intrapriming(spark, sf):
    p = _packed_once(spark, sf, Mode.POLYA)
    reads = polya.with_scores(_polya_reads(polya.location_of_end(p.where("not is_ref"), p.where("is_ref"))), score_track(spark, sf))
    return polya.intrapriming(reads, recover=True).withColumn("ratio", F.col("ratio").cast("double"))


def tails(spark, sf) -> DataFrame:
    """Whole texts as bases, after a run of A."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    body = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BDEFHIJKLMNOPQRSUVWXYZ", "CAAGATCAGTTAACCGGATCTA")
    return docs.select("doc_id", F.concat(F.repeat(F.lit("A"), (F.col("doc_id") % 60).cast("int")), body).alias("seq"))


TAIL_SQL = """WITH RECURSIVE b AS (SELECT doc_id, concat(repeat('A', CAST(doc_id % 60 AS INT)), translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'CAAGATCAGTTAACCGGATCTA')) AS seq FROM documents)"""


@query("polya_tail", TAIL_SQL + """, p AS (SELECT doc_id, length(seq) AS n, unnest(range(1, length(seq) + 1)) AS k, unnest(string_split(seq, '')) AS base FROM b WHERE seq <> ''),
 e AS (SELECT doc_id, n, k, sum(CASE WHEN base = 'A' THEN ln(0.99) ELSE ln((1 - 0.99) / 3) END) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM p),
 s AS (SELECT doc_id, k, ln(0.5) + (k - 1) * ln(0.9) + e + CASE WHEN k < n THEN ln(1 - 0.9) + (n - k) * ln(0.25) ELSE 0 END AS v FROM e UNION ALL SELECT doc_id, 0, ln(0.5) + length(seq) * ln(0.25) FROM b)
 SELECT doc_id, CAST(arg_max(k, v) AS BIGINT) AS tail FROM s GROUP BY doc_id""")
def polya_tail(spark, sf):
    return tails(spark, sf).select("doc_id", polya.tail_length(F.col("seq")).cast("long").alias("tail"))


# --- sequences --------------------------------------------------------------------------------------


@query("revcomp", TAIL_SQL + " SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM b")
def revcomp(spark, sf):
    return tails(spark, sf).select("doc_id", dna.reverse_complement(F.col("seq")).alias("rc"))


# --- tables, sets, chunks ---------------------------------------------------------------------------


@query("bedgraph_max", BASE + ", sc AS (SELECT chrom, strand, tend - tend % 500 AS s, CAST(k % 100 AS DOUBLE) / 1000 AS score FROM tx) SELECT chrom, s AS \"start\", s + 500 AS \"end\", strand, max(score) AS score FROM sc GROUP BY ALL")
def bedgraph_max(spark, sf):
    from strandloom.sources.text import max_signal

    tx = transcripts(spark, sf)
    at = F.col("end") - F.col("end") % 500
    return max_signal(tx.select("chrom", at.alias("start"), (at + 500).alias("end"), "strand", ((F.col("k") % 100).cast("double") / 1000).alias("score")))


@query("score_nested_map", BASE + ", sc AS (SELECT chrom, tend - tend % 2000 AS p, k % 100 AS score FROM tx) SELECT chrom, p AS key, count(*) AS n, max(score) AS max_score, CAST(avg(score) AS DOUBLE) AS avg_score FROM sc GROUP BY ALL")
def score_nested_map(spark, sf):
    tx = transcripts(spark, sf)
    return text.score_summary(text.nested_scores(tx.select("chrom", (F.col("end") - F.col("end") % 2000).alias("key"), (F.col("k") % 100).alias("score"))))


def new_folder(spark, name: str, suffix: str = "") -> str:
    """A new folder of the shared directory, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}{suffix}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _lines(df: DataFrame, name: str, suffix: str = "") -> str:
    """The rows as a tab-separated folder of the shared directory, for queries that read files."""
    path = new_folder(df.sparkSession, name, suffix)
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("line")).write.text(path)
    return path


@query("isoform_map", BASE + "SELECT concat('TX.G', k - k % 40, '.', k) AS transcript, concat('G', k - k % 40) AS gene FROM tx WHERE is_ref")
def isoform_map(spark, sf):
    refs = transcripts(spark, sf).where("is_ref").select(coords.gene_token(F.col("name")).alias("gene"), F.col("name").alias("transcript"))
    return text.read_isoforms(spark, _lines(refs, "isoforms")).select("transcript", "gene")


@query("blacklist_anti", BASE + "SELECT k FROM tx WHERE NOT is_ref AND k % 97 <> 0")
def blacklist_anti(spark, sf):
    tx = transcripts(spark, sf).where("not is_ref")
    names = text.read_names(spark, _lines(tx.where("k % 97 = 0").select("name"), "names"))
    return intervals.without_names(tx, names).select("k")


@query("blacklist_interval", BASE + ", bi AS (SELECT DISTINCT chrom, s, e FROM introns WHERE s % 53 = 0) SELECT i.k, i.s, i.e FROM introns i ANTI JOIN bi ON bi.chrom = i.chrom AND bi.s = i.s AND bi.e = i.e")
def blacklist_interval(spark, sf):
    rows = transcripts(spark, sf).select("k", "chrom", F.explode("introns").alias("i")).select("k", "chrom", F.col("i.start").alias("s"), F.col("i.end").alias("e"))
    # files hold whole introns, which are shrunk by one at both sides when read
    whole = rows.where("s % 53 = 0").select("chrom", F.col("s") - 1, F.col("e") + 1, "k")
    return intervals.without_intervals(rows, text.read_bed4(spark, _lines(whole, "introns"), strand_aware=False), "s", "e").select("k", "s", "e")


@query("read_bed12", BASE + ' SELECT k, chrom, strand, tstart AS "start", tend AS "end", cs AS cds_start, ce AS cds_end, n AS n_exons FROM tx JOIN (SELECT k, count(*) AS n FROM exons GROUP BY k) USING (k)')
def read_bed12(spark, sf):
    b = fixtures.bed12(spark, sf).withColumn("name", F.col("k").cast("string")).drop("k", "is_ref")
    tx = text.read_bed12(spark, _lines(b, "transcripts"))
    return tx.select(F.col("name").cast("long").alias("k"), "chrom", "strand", "start", "end", "cds_start", "cds_end", F.size("exons").cast("long").alias("n_exons"))


@query("read_bed4", BASE + ' SELECT k, chrom, ps + 1 AS "start", pe - 1 AS "end" FROM tx JOIN pt USING (k) UNION ALL SELECT k, chrom, 100000000000 - pe + 1, 100000000000 - ps - 1 FROM tx JOIN pt USING (k)')
def read_bed4(spark, sf):
    b = fixtures.bed12(spark, sf).select("chrom", "start", "end", "k")
    return text.read_bed4(spark, _lines(b, "intervals")).select(F.col("id").cast("long").alias("k"), "chrom", "start", "end")


@query("read_bed6", BASE + ' SELECT k, chrom, tstart AS "start", tend AS "end", CAST(k % 16 AS DOUBLE) / 4 AS score, strand FROM tx')
def read_bed6(spark, sf):
    b = fixtures.bed12(spark, sf).select("chrom", "start", "end", "k", (F.col("k") % 16 / 4).alias("score"), "strand")
    return text.read_bed6(spark, _lines(b, "scored")).select(F.col("id").cast("long").alias("k"), "chrom", "start", "end", F.col("score").cast("double").alias("score"), "strand")


@query("read_polya", BASE + ' SELECT k, chrom, tstart AS "start", tend AS "end", cs AS cds_start, ce AS cds_end FROM tx')
def read_polya(spark, sf):
    b = fixtures.bed12(spark, sf).select("chrom", "start", "end", "k", "score", "strand", "thick_start", "thick_end")
    return text.read_polya(spark, _lines(b, "tails")).select(F.col("name").cast("long").alias("k"), "chrom", "start", "end", "cds_start", "cds_end")


@query("read_bedgraph", BASE + ' SELECT chrom, ps AS "start", pe AS "end", strand, max(CAST(k % 16 AS DOUBLE) / 4) AS score FROM tx JOIN pt USING (k) GROUP BY ALL')
def read_bedgraph(spark, sf):
    b = fixtures.bed12(spark, sf).select("chrom", "start", "end", (F.col("k") % 16 / 4).alias("score"), "strand")
    return text.max_signal(text.read_bedgraph(spark, _lines(b, "signal")))


@query("intron_lines", INTRON_TABLE + " SELECT chrom, s AS \"start\", e AS \"end\", strand, seen, spanned, position AS intron_position, is_toga AS is_toga_supported, in_frame AS is_in_frame, support FROM su")
def intron_lines(spark, sf):
    """The 22-column lines, written and read again."""
    t = scored_introns(_packed_once(spark, sf, Mode.INTRON))
    renamed = t.withColumnsRenamed({"istart": "start", "iend": "end", "position": "intron_position", "is_toga": "is_toga_supported", "in_frame": "is_in_frame", "ai_donor": "splice_ai_donor", "ai_acceptor": "splice_ai_acceptor", "me_donor": "max_ent_donor", "me_acceptor": "max_ent_acceptor", "is_rt": "is_rt_intron"})
    whole = renamed.withColumns({c: F.lit("N") for c in ("donor_sequence", "acceptor_sequence", "donor_context", "acceptor_context", "donor_rt_context", "acceptor_rt_context")} | {"is_nag_intron": F.lit(False)})
    back = text.read_introns(spark, _lines(text.intron_lines(whole), "introns"))
    return back.select("chrom", "start", "end", "strand", "seen", "spanned", "intron_position", "is_toga_supported", "is_in_frame", "support")


@query("fasta_records", BASE + " SELECT concat('s', k) AS name, concat(repeat('ACGT', CAST(k % 7 + 1 AS INT)), repeat('N', CAST(k % 3 AS INT))) AS seq FROM tx")
def fasta_records(spark, sf):
    tx = transcripts(spark, sf).select(F.concat(F.lit(">s"), "k", F.lit("\n"), F.repeat(F.lit("ACGT"), (F.col("k") % 7 + 1).cast("int")), F.lit("\n"), F.repeat(F.lit("N"), (F.col("k") % 3).cast("int"))).alias("r"))
    return sequences.read_fasta(spark, _lines(tx, "records", ".fa"))


@query("category_folders", BASE + " SELECT category, concat('line', k // 3) AS line FROM (SELECT k, CASE WHEN k % 3 = 0 THEN 'keep' WHEN k % 3 = 1 THEN 'review' END AS category FROM tx) WHERE category IS NOT NULL GROUP BY ALL")
def category_folders(spark, sf):
    category = F.when(F.col("k") % 3 == 0, "keep").when(F.col("k") % 3 == 1, "review")
    rows = transcripts(spark, sf).select(category.alias("category"), F.concat(F.lit("line"), F.floor(F.col("k") / 3)).alias("line"))
    path = new_folder(spark, "categories")
    descriptor.write_categories(rows.union(rows), path)
    return spark.read.text(path).select("category", F.col("value").alias("line"))


@query("descriptor_json", BASE + " SELECT k AS id, CASE WHEN k % 3 <> 0 THEN is_ref END AS flag, chrom FROM tx")
def descriptor_json(spark, sf):
    t = transcripts(spark, sf).select(F.col("k").alias("id"), F.when(F.col("k") % 3 != 0, F.col("is_ref")).alias("flag"), "chrom")
    path = new_folder(spark, "json")
    descriptor.write_json(t, path)
    return spark.read.schema(t.schema).json(path)


BASE_AT = "substr('ACGT', CAST((p * p + p // 5) % 4 + 1 AS INT), 1)"
WINDOW_SQL = ", wn AS (SELECT k, strand, 200 + (k % 1000) * 100 AS a, 200 + (k % 1000) * 100 + 60 AS z FROM tx WHERE 200 + (k % 1000) * 100 + 60 <= 100100)"


def small_genome(spark) -> DataFrame:
    """(chrom, tile, seq, chrom_size): 100,100 bases of each of five chromosomes by a formula, in tiles of 4,096."""
    base = lambda p: F.substring(F.lit("ACGT"), ((p * p + F.floor(p / 5)) % 4 + 1).cast("int"), F.lit(1))
    tiles = spark.range(25).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c"), F.col("id").alias("tile"))
    seq = F.array_join(F.transform(F.sequence(F.col("tile") * 4096, F.least(F.col("tile") * 4096 + 4095, F.lit(100_099))), base), "")
    return tiles.select(F.concat(F.lit("chr"), "c").alias("chrom"), "tile", seq.alias("seq"), F.lit(100_100).cast("long").alias("chrom_size"))


@query("window_sequences", BASE + WINDOW_SQL + f", sq AS (SELECT k, strand, string_agg({BASE_AT}, '' ORDER BY p) AS s FROM (SELECT k, strand, unnest(range(a, z)) AS p FROM wn) GROUP BY k, strand) SELECT k, CASE WHEN strand = '-' THEN translate(reverse(s), 'ACGT', 'TGCA') ELSE s END AS seq FROM sq")
def window_sequences(spark, sf):
    start = 200 + F.col("k") % 1000 * 100
    w = transcripts(spark, sf).select("k", "chrom", start.alias("start"), (start + 60).alias("end"), F.col("k").cast("string").alias("name"), "strand")
    return cutsites.window_sequences(w, small_genome(spark), tile=4096).select("k", "seq")


@query("splice_contexts", BASE + WINDOW_SQL + f""", ct AS (SELECT k, strand, a - 1 AS s, z + 1 AS e FROM wn),
 rg AS (SELECT k, strand, CASE WHEN strand = '+' THEN s - 8 ELSE e - 9 END AS d0, CASE WHEN strand = '+' THEN e - 20 ELSE s - 3 END AS a0 FROM ct),
 dn AS (SELECT k, strand, string_agg({BASE_AT}, '' ORDER BY p) AS x FROM (SELECT k, strand, unnest(range(d0, d0 + 17)) AS p FROM rg) GROUP BY ALL), ac AS (SELECT k, strand, string_agg({BASE_AT}, '' ORDER BY p) AS x FROM (SELECT k, strand, unnest(range(a0, a0 + 23)) AS p FROM rg) GROUP BY ALL)
 SELECT dn.k, CASE WHEN dn.strand = '-' THEN translate(reverse(dn.x), 'ACGT', 'TGCA') ELSE dn.x END AS donor, CASE WHEN dn.strand = '-' THEN translate(reverse(ac.x), 'ACGT', 'TGCA') ELSE ac.x END AS acceptor FROM dn JOIN ac USING (k)""")
def splice_contexts(spark, sf):
    start = 200 + F.col("k") % 1000 * 100
    tx = transcripts(spark, sf).select("k", "chrom", "strand", start.alias("a"), (start + 60).alias("z")).where("z <= 100100")
    s, e = coords.mirrored(F.col("strand"), F.col("a"), F.col("z"))
    return classify.splice_contexts(tx.withColumns({"istart": s, "iend": e}), small_genome(spark), tile=4096).select("k", "donor", "acceptor")


@query("dna_functions", TAIL_SQL + """ SELECT doc_id, translate(seq, 'ACGT', 'TGCA') AS comp, substring(seq, 6, 20) AS cut, concat(substring(seq, 1, 5), substring(seq, 26)) AS skipped, concat('AAA', seq) AS front, concat(seq, 'AA') AS back,
 translate(seq, 'ACTG', '0123') AS codes, translate(reverse(substring(seq, 6, 20)), 'ACTG', '0123') AS reversed FROM b""")
def dna_functions(spark, sf):
    seq = F.col("seq")
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    return tails(spark, sf).select(
        "doc_id", dna.complement(seq).alias("comp"), dna.cut(seq, 5, 25).alias("cut"), dna.skip(seq, 5, 25).alias("skipped"), dna.fill(seq, 3).alias("front"), dna.fill_back(seq, 2).alias("back"),
        text_of(dna.encode2(seq)).alias("codes"), text_of(dna.reverse_encode2(seq, 5, 25)).alias("reversed"),
    )


@query("descriptor_merge", RETAINED + ", nm AS (SELECT k, k % 5 AS fc FROM tx WHERE NOT is_ref AND k % 3 = 0) SELECT k AS id, has_rt_intron, exonic_status, fc FROM (SELECT k, has_rt_intron, exonic_status FROM vr WHERE k % 2 = 0) FULL JOIN nm USING (k)")
def descriptor_merge(spark, sf):
    from strandloom.operators.descriptor import merge

    a = _retention(spark, sf).where("k % 2 = 0").select(F.col("k").alias("id"), "has_rt_intron", "exonic_status")
    b = transcripts(spark, sf).where("not is_ref and k % 3 = 0").select(F.col("k").alias("id"), (F.col("k") % 5).alias("fc"))
    return merge(a, b)


FLAGS = "k % 3 = 0 AS a, k % 5 = 0 AS b, k % 7 = 0 AS c, k % 4 = 0 AS d"


@query("read_category", BASE + f", f AS (SELECT k, {FLAGS} FROM tx WHERE NOT is_ref) SELECT k, CASE WHEN a::INT + b::INT + c::INT + d::INT >= 2 THEN 'trash' WHEN c THEN 'rt' WHEN a THEN 'intrapriming' WHEN d THEN 'retention' WHEN NOT b THEN 'clean' END AS category FROM f")
def read_category(spark, sf):
    from strandloom.operators.descriptor import category

    k = F.col("k")
    return transcripts(spark, sf).where("not is_ref").select("k", category(k % 3 == 0, k % 5 == 0, k % 7 == 0, k % 4 == 0).alias("category"))


@query("chunk_ids", BASE + "SELECT k, (row_number() OVER (ORDER BY k) - 1) // 500 AS chunk FROM tx")
def chunk_ids(spark, sf):
    from strandloom.sources.sequences import with_chunk

    return with_chunk(transcripts(spark, sf).select("k"), ["k"], 500).select("k", "chunk")


@query("dedup_lines", "SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def dedup_lines(spark, sf):
    from strandloom.sources.text import distinct_lines

    return distinct_lines(spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line")))


@query("splice_scores", INTRON_TABLE + " SELECT comp, s AS istart, e AS iend, CASE WHEN s % 3 = 0 THEN ai_donor ELSE 0 END AS ai_donor, CASE WHEN s % 3 = 0 THEN ai_acceptor ELSE 0 END AS ai_acceptor FROM ai")
def splice_scores(spark, sf):
    return scored_introns(_packed_once(spark, sf, Mode.INTRON)).select("comp", "istart", "iend", "ai_donor", "ai_acceptor")


@query("global_counters", RETAINED + " SELECT count(DISTINCT comp) AS components, count(*) AS reads, count(*) FILTER (WHERE number_of_retentions > 0) AS retentions, count(DISTINCT comp) FILTER (WHERE ratio > 0.001) AS reviews FROM vr")
def global_counters(spark, sf):
    return retention.counters(_retention(spark, sf))


# --- further operators ------------------------------------------------------------------------------


@query("fusion_mapping", FUSION + """, gx AS (SELECT comp, count(DISTINCT gene) AS genes FROM comp JOIN (SELECT DISTINCT k, gene FROM refx) USING (k) GROUP BY comp),
 tg AS (SELECT q.k, count(DISTINCT r.gene) AS n FROM fx q JOIN comp cq ON cq.k = q.k JOIN comp c ON c.comp = cq.comp JOIN refx r ON r.k = c.k WHERE NOT q.is_ref AND q.s < r.e AND r.s < q.e GROUP BY q.k),
 sg AS (SELECT q.k, count(DISTINCT r2.gene) AS n FROM ps q JOIN comp cq ON cq.k = q.k JOIN comp c ON c.comp = cq.comp JOIN ps r ON r.k = c.k AND r.is_ref AND r.p = q.p JOIN (SELECT DISTINCT k, gene FROM refx) r2 ON r2.k = r.k WHERE NOT q.is_ref GROUP BY q.k)
 SELECT k, CASE WHEN coalesce(genes, 0) > 1 AND coalesce(tg.n, 0) > 1 THEN CASE WHEN coalesce(sg.n, 0) > 1 THEN 'fusions' ELSE 'dropped' END ELSE 'pass' END AS category FROM qx JOIN comp USING (k) LEFT JOIN gx USING (comp) LEFT JOIN tg USING (k) LEFT JOIN sg USING (k)""")
def fusion_mapping(spark, sf):
    tx = fusion_fixture(spark, sf)
    isoforms = tx.where("is_ref").select("gene", F.col("name").alias("transcript"))
    return fusion.mapping_verdicts(components.pack(tx).withColumn("locus", F.lit(None).cast("string")), isoforms).select("k", "category")


@query("cds_hull", REF_PACK + " SELECT comp, min(cs) AS h0, max(ce) AS h1 FROM pk WHERE is_ref GROUP BY comp")
def cds_hull(spark, sf):
    return classify.cds_hull(_packed(spark, sf, Mode.INTRON))


@query("gene_exon_union", EXON_PACK + ", gx AS (SELECT DISTINCT comp, concat('G', k - k % 40) AS gene, s, e FROM packed JOIN (SELECT k, s, e FROM exons) USING (k) WHERE is_ref) SELECT comp, gene, " + LIST + " AS exons FROM gx GROUP BY comp, gene")
def gene_exon_union(spark, sf):
    refs = _packed(spark, sf).where("is_ref").withColumn("gene", coords.gene_token(F.col("name")))
    return components.gene_exons(refs).select("comp", "gene", _text("exons").alias("exons"))


@query("component_genes", EXON_PACK + ", g AS (SELECT DISTINCT comp, concat('G', k - k % 40) AS gene FROM packed WHERE is_ref) SELECT comp, count(*) AS n_genes, string_agg(gene, '.' ORDER BY gene) AS merged FROM g GROUP BY comp")
def component_genes(spark, sf):
    return components.merged_genes(_packed(spark, sf).where("is_ref").withColumn("gene", coords.gene_token(F.col("name"))))


@query("nag_shift", INTRON_TABLE + """, n AS (SELECT comp, s, e, substring('CAGTAGAAGCCC', CAST(1 + 3 * (s % 4) AS INT), 3) AS b, substring('CAGTAGAAGCCC', CAST(1 + 3 * (e % 4) AS INT), 3) AS a FROM it WHERE is_toga AND s % 2 = 0)
 SELECT comp, s AS istart, e - 3 AS iend FROM n WHERE b IN ('CAG', 'TAG', 'AAG') UNION ALL SELECT comp, s, e + 3 FROM n WHERE a IN ('CAG', 'TAG', 'AAG')""")
def nag_shift(spark, sf):
    pick = lambda c: F.substring(F.lit("CAGTAGAAGCCC"), (1 + 3 * (F.col(c) % 4)).cast("int"), F.lit(3))
    contexts = F.struct(F.when(F.col("istart") % 2 == 0, "AG").otherwise("AC").alias("acceptor"), pick("istart").alias("before"), pick("iend").alias("after"))
    return classify.nag_shift(classify.intron_table(_packed_once(spark, sf, Mode.INTRON)), contexts).select("comp", "istart", "iend")


@query("end_windows", BASE + 'SELECT k, chrom, CASE WHEN strand = \'-\' THEN ps ELSE pe END - 150 AS "start", CASE WHEN strand = \'-\' THEN ps ELSE pe END + 150 AS "end" FROM tx JOIN (SELECT k, ps, pe FROM pc) USING (k) WHERE ps >= 200')
def end_windows(spark, sf):
    from strandloom.sources.text import end_windows as windows

    bed = fixtures.bed12(spark, sf).withColumn("name", F.col("k").cast("string"))
    return windows(bed).select(F.col("name").cast("long").alias("k"), "chrom", "start", "end")


@query("read_quality", BASE + ", r AS (SELECT k, CAST(CAST(55 + k % 46 AS DOUBLE) AS FLOAT) AS identity, k % 25 AS c5, k % 23 AS c3 FROM tx) SELECT k, CASE WHEN identity < 60 THEN 'drop' WHEN identity >= 98 AND c5 <= 20 AND c3 <= 20 THEN 'accept' ELSE 'reject' END AS verdict FROM r")
def read_quality(spark, sf):
    k = F.col("k")
    return transcripts(spark, sf).select("k", polya.read_quality((55 + k % 46).cast("float"), k % 25, k % 23).alias("verdict"))


@query("tag_read", BASE + "SELECT k, concat('r', k, '__FC', k % 5, '#TC', k % 3, '#PA', k % 60, '#PR', k % 70, '#IY', (55 + k % 46) * 10) AS name FROM tx")
def tag_read(spark, sf):
    k = F.col("k")
    return transcripts(spark, sf).select("k", polya.tag_name(F.concat(F.lit("r"), k), k % 5, k % 3, k % 60, k % 70, (55 + k % 46).cast("double")).alias("name"))


@query("cigar_features", BASE + """, c AS (SELECT k, strand, k % 7 AS l, k % 11 AS r, 50 + k % 40 AS m, k % 6 AS x, k % 3 AS d FROM tx)
 SELECT k, CASE WHEN strand = '-' THEN r ELSE l END AS five_clip, CASE WHEN strand = '-' THEN l ELSE r END AS three_clip, m + 30 AS matches, m + 30 + x + 1 + d + 1 AS alignment_length, CASE WHEN strand = '-' THEN 1000 ELSE 1000 + m + 30 + x + 1 + d + 1 + 100 END AS end_site FROM c""")
def cigar_features(spark, sf):
    from strandloom.operators.alignments import features

    k = F.col("k")
    n = lambda v, op: F.when(v > 0, F.concat(v.cast("string"), F.lit(op))).otherwise("")
    cigar = F.concat(n(k % 7, "S"), n(50 + k % 40, "="), n(k % 6 + 1, "X"), n(k % 3 + 1, "D"), F.lit("100N30="), n(k % 11, "S"))
    rows = transcripts(spark, sf).select("k", F.when(F.col("strand") == "-", 16).otherwise(0).alias("flag"), F.lit(1000).cast("bigint").alias("start"), cigar.alias("cigar"), F.lit("A").alias("seq"))
    return features(rows).select("k", "five_clip", "three_clip", "matches", "alignment_length", "end_site")


@query("distinct_alignments", BASE + "SELECT DISTINCT k % 50 AS name, tstart AS \"start\" FROM tx")
def distinct_alignments(spark, sf):
    return alignments.once(transcripts(spark, sf).select((F.col("k") % 50).alias("name"), "start"))


@query("descriptor_tsv", BASE + "SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 3 = 0 THEN 'NULL' ELSE CAST(is_ref AS VARCHAR) END AS flag, concat('[\"', chrom, '\",\"', strand, '\"]') AS parts FROM tx")
def descriptor_tsv(spark, sf):
    from strandloom.operators.descriptor import rendered

    t = transcripts(spark, sf).select(F.col("k").alias("id"), F.when(F.col("k") % 3 != 0, F.col("is_ref")).alias("flag"), F.array("chrom", "strand").alias("parts"))
    return rendered(t)


@query("bed12_line", BASE + """, b AS (SELECT k, string_agg(e - s, ',' ORDER BY s) AS sizes, string_agg(s - ps, ',' ORDER BY s) AS starts, count(*) AS n FROM plain JOIN (SELECT k, ps FROM pc) USING (k) GROUP BY k)
 SELECT concat_ws(chr(9), concat('chr', k % 5), ps, pe, concat('T', k), k % 10, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END, pcs, pce, '125,40,40', n, concat(sizes, ','), concat(starts, ',')) AS line FROM pc JOIN b USING (k)""")
def bed12_line(spark, sf):
    from strandloom.sources.text import bed12_lines

    named = transcripts(spark, sf).withColumns({"name": F.concat(F.lit("T"), "k"), "score": (F.col("k") % 10).cast("string"), "rgb": F.lit(config.STRONG_NMD_RGB)})
    return bed12_lines(named)


@query("reference_frames", INTRON_TABLE + " SELECT in_frame, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS bases FROM it GROUP BY in_frame")
def reference_frames(spark, sf):
    return classify.frames(classify.intron_table(_packed_once(spark, sf, Mode.INTRON)))


# --- keys, lines, tracks ----------------------------------------------------------------------------


@query("nested_attributes", BASE + " SELECT chrom, tstart % 97 AS key, string_agg(concat(tend, '-', k), ',' ORDER BY tend, k) AS attributes FROM tx GROUP BY ALL")
def nested_attributes(spark, sf):
    tx = transcripts(spark, sf).withColumn("bin", F.col("start") % 97)
    found = text.nested_attributes(tx, "bin", "end", "k")
    return found.select("chrom", "key", F.array_join(F.transform("attributes", lambda a: F.concat_ws("-", a["end"].cast("string"), a["k"].cast("string"))), ",").alias("attributes"))


@query("first_of_key", BASE + """, ky AS (SELECT chrom, tstart, tend, k, concat('p_', upper(split_part(CASE WHEN is_ref THEN concat('TX.G', k - k % 40, '.', k) ELSE concat('R', k, '_', chrom) END, '.', 2)), '_s') AS key, is_ref FROM tx),
 kz AS (SELECT chrom, CASE WHEN is_ref THEN key ELSE concat('p_', upper(concat('R', k, '_', chrom)), '_s') END AS key, tstart, tend, k FROM ky)
 SELECT chrom, key, min_by(k, (tstart, k)) AS k, min(tstart) AS "start" FROM kz GROUP BY ALL""")
def first_of_key(spark, sf):
    tx = transcripts(spark, sf).select("chrom", "start", "k", F.when(F.col("is_ref"), F.col("name")).otherwise(F.concat_ws("_", F.concat(F.lit("R"), F.col("k")), "chrom")).alias("name"))
    found = text.first_of_key(tx, text.key_of("name", split=(".", 1), case="upper", prefix="p_", suffix="_s"), "start", "k")
    return found.select("chrom", "key", "k", "start")


@query("padded_key", BASE + " SELECT k, CAST(greatest(tstart - 5000, 0) AS VARCHAR) AS low, CAST(tstart + 5000 AS VARCHAR) AS high FROM tx")
def padded_key(spark, sf):
    return transcripts(spark, sf).select("k", text.key_of("start", padding=-5000).alias("low"), text.key_of("start", padding=5000).alias("high"))


LINE_SQL = """, bx AS (SELECT k, count(*) AS n, string_agg(e - s, ',' ORDER BY s, e) AS sizes, string_agg(s - ps, ',' ORDER BY s, e) AS offs FROM plain JOIN pt USING (k) GROUP BY k),
 ln AS (SELECT tx.k, chrom, ps, pe, strand, pcs, pce, n, sizes, offs FROM tx JOIN pc USING (k) JOIN bx USING (k) WHERE is_ref)"""


@query("bed_line_clamped", BASE + LINE_SQL + """ SELECT k, concat_ws(chr(9), chrom, ps, pe, concat('TX.G', k - k % 40, '.', k), '0', strand, greatest(CASE WHEN strand = '-' THEN pcs - 7 ELSE pcs - 40 END, ps), least(CASE WHEN strand = '-' THEN pce + 40 ELSE pce + 7 END, pe), '0,0,0', n, concat(sizes, ','), concat(offs, ',')) AS line FROM ln""")
def bed_line_clamped(spark, sf):
    tx = transcripts(spark, sf).where("is_ref")
    moved = text.with_cds(tx, F.col("cds_start") - 40, F.col("cds_end") + 7)
    lines = text.bed12_lines(moved.withColumns({"score": F.lit("0"), "rgb": F.lit("0,0,0")}))
    return lines.select(F.regexp_extract("line", r"TX\.G[0-9]+\.([0-9]+)", 1).cast("long").alias("k"), "line")


@query("edited_lines", BASE + LINE_SQL + """ SELECT concat_ws(chr(9), chrom, ps, pe, concat('N', ps), '0', strand, pcs, pce, '222,166,62', n, concat(sizes, ','), concat(offs, ',')) AS line FROM ln""")
def edited_lines(spark, sf):
    lines = text.bed12_lines(transcripts(spark, sf).where("is_ref").withColumns({"score": F.lit("0"), "rgb": F.lit("0,0,0")}))
    named = lines.select(text.with_field(F.col("line"), 3, F.concat(F.lit("N"), F.split("line", "\t")[1])).alias("line"))
    return named.select(text.with_field(F.col("line"), 8, config.REVIEW_RGB).alias("line"))


@query("wiggle_switch", INTRON_TABLE + """, wh AS (SELECT DISTINCT a.comp, a.s, a.e, true AS hit FROM su a JOIN (VALUES (-2), (2), (-4), (4)) v(m) ON true JOIN su b ON b.comp = a.comp AND b.s = a.s - m AND b.e = a.e - m WHERE a.is_toga)
 SELECT comp, s AS istart, e AS iend, is_toga OR coalesce(hit, false) AS is_toga, CASE WHEN hit THEN 'SPLICED' ELSE support END AS support FROM su LEFT JOIN wh USING (comp, s, e)""")
def wiggle_switch(spark, sf):
    t = materialize(scored_introns(_packed_once(spark, sf, Mode.INTRON)), "introns")
    return classify.wiggled(t, t.where("is_toga")).select("comp", "istart", "iend", "is_toga", "support")


@query("bedgraph_lines", BASE + " SELECT strand, concat_ws(chr(9), chrom, ps, pe, CAST(k % 100 AS DOUBLE) / 8) AS line FROM tx JOIN pt USING (k)")
def bedgraph_lines(spark, sf):
    b = fixtures.bed12(spark, sf)
    return text.bedgraph_lines(b.select("chrom", "start", "end", ((F.col("k") % 100).cast("double") / 8).alias("score"), "strand"))


@query("highest_place", BASE + " SELECT chrom AS name, min_by(tend, (-(k % 100), tend)) AS \"start\", CAST(max(k % 100) AS DOUBLE) / 8 AS score FROM tx GROUP BY chrom")
def highest_place(spark, sf):
    from strandloom.operators.cutsites import highest

    return highest(transcripts(spark, sf).select(F.col("chrom").alias("name"), F.col("end").alias("start"), ((F.col("k") % 100).cast("double") / 8).alias("score")))


from strandloom.plans import files  # noqa: E402, F401  its queries are registered here
