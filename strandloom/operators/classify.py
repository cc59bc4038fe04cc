"""Reference-intron table: counts, position, splice scores and support per component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import config
from strandloom.config import SCALE
from strandloom.functions.dna import acceptor_score
from strandloom.operators.intervals import point_join

REACH = 20


def intron_rows(packed: DataFrame) -> DataFrame:
    return packed.select("comp", "chrom", "strand", "is_ref", F.explode("introns").alias("i")).select("comp", "chrom", "strand", "is_ref", F.col("i.start").alias("istart"), F.col("i.end").alias("iend"))


def cds_hull(packed: DataFrame) -> DataFrame:
    """(comp, h0, h1): where the references' CDS of a component begin and end."""
    return packed.where("is_ref").groupBy("comp").agg(F.min("cds_start").alias("h0"), F.max("cds_end").alias("h1"))


def frames(table: DataFrame) -> DataFrame:
    """(in_frame, n, bases): introns, and their bases, in and out of frame."""
    return table.groupBy("in_frame").agg(F.count("*").alias("n"), F.sum(F.col("iend") - F.col("istart")).alias("bases"))


def intron_table(packed: DataFrame) -> DataFrame:
    """One row per component and intron: seen, spanned, position, is_toga, in_frame.

    Queries are the reads, references the annotation. An annotated intron that no read shows has
    counts of 0, position CDS and is not in frame. Frames are taken on the shrunk intron.
    """
    rows = intron_rows(packed)
    keys = ["comp", "chrom", "strand", "istart", "iend"]
    table = rows.groupBy(*keys).agg(F.count_if(~F.col("is_ref")).alias("seen"), F.bool_or("is_ref").alias("is_toga"))
    hull = cds_hull(packed)
    reads = packed.where("not is_ref").select("comp", F.col("start").alias("rs"), F.col("end").alias("re"))
    spanned = point_join(reads, table.where("seen > 0").select("comp", "istart", "iend"), ["comp"], "rs", "re", "istart").where("iend <= re").groupBy("comp", "istart", "iend").agg(F.count("*").alias("spanned"))
    t = table.join(spanned, ["comp", "istart", "iend"], "left").join(hull, "comp", "left").withColumns({"spanned": F.coalesce("spanned", F.lit(0)), "h0": F.coalesce("h0", F.lit(2**63 - 1)), "h1": F.coalesce("h1", F.lit(0))})
    s, e, a, b = F.col("istart"), F.col("iend"), F.col("h0"), F.col("h1")
    position = (
        F.when(F.col("is_toga") | ((a < s) & (e < b)), "CDS")
        .when(((s > b) | (e < a)) & (b > 0), "UTR")
        .when(((s < a) & (e < b)) | ((s < b) & (e > b)), "Mixed")
        .otherwise("Unknown")
    )
    return t.select(*keys, "seen", "spanned", position.alias("position"), "is_toga", ((F.col("seen") > 0) & ((e - s) % 3 == 0)).alias("in_frame"))


def splice_positions(strand: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Donor and acceptor positions in plain coordinates, as splice scores are keyed."""
    return F.when(strand == "-", SCALE - start).otherwise(start - 1), F.when(strand == "-", SCALE - end - 1).otherwise(end)


def with_splice_scores(introns: DataFrame, scores: DataFrame) -> DataFrame:
    """``introns`` with ai_donor and ai_acceptor from (chrom, strand, site, pos, score); 0 where there is none."""
    donor, acceptor = splice_positions(F.col("strand"), F.col("istart"), F.col("iend"))
    x = introns.withColumns({"_d": donor, "_a": acceptor})
    for site, pos in (("donor", "_d"), ("acceptor", "_a")):
        s = scores.where((F.col("site") == site) & ~F.isnan("score")).select("chrom", "strand", F.col("pos").alias(pos), F.col("score").alias(f"ai_{site}"))
        x = x.join(s, ["chrom", "strand", pos], "left").withColumn(f"ai_{site}", F.coalesce(f"ai_{site}", F.lit(0.0)))
    return x.drop("_d", "_a")


def support() -> Column:
    """SPLICED, RT or UNCLEAR from is_rt, is_toga, ai_donor, ai_acceptor, seen, spanned, me_donor, me_acceptor."""
    c = F.col
    at_least = lambda x, t: ~F.isnan(x) & (c(x) >= t)
    ai = at_least("ai_donor", config.SPLICE_AI_SCORE_RECOVERY_THRESHOLD) & at_least("ai_acceptor", config.SPLICE_AI_SCORE_RECOVERY_THRESHOLD)
    often = F.coalesce(F.try_divide(c("seen"), c("spanned")) >= config.INTRON_FREQUENCY_RECOVERY_THRESHOLD, F.lit(False))
    entropy = at_least("me_donor", config.MAX_ENT_SCORE_RECOVERY_THRESHOLD) & at_least("me_acceptor", config.MAX_ENT_SCORE_RECOVERY_THRESHOLD) & (c("ai_donor") > 0) & (c("ai_acceptor") > 0)
    return F.when(c("is_rt") & c("is_toga"), "SPLICED").when(c("is_rt"), "RT").when(c("is_toga") | ai | often | entropy, "SPLICED").otherwise("UNCLEAR")


def with_max_entropy(introns: DataFrame, donors: DataFrame, acceptors: DataFrame) -> DataFrame:
    """``introns`` (donor and acceptor contexts) with me_donor and me_acceptor.

    ``donors``: (kmer, score), met by the 9 bases from the 8th on; missing ones score 0. ``acceptors``:
    (kmer, s0 to s8); there are at most 4^7 k-mers, so the table is one row, a map.
    """
    scores = F.array(*(F.col(f"s{i}") for i in range(9)))
    table = acceptors.agg(F.map_from_entries(F.collect_list(F.struct("kmer", scores))).alias("_t"))
    d = donors.select(F.col("kmer").alias("_k"), F.col("score").alias("_d"))
    x = introns.withColumn("_k", F.substring("donor", 9, 9)).join(d, "_k", "left").join(F.broadcast(table))
    return x.withColumns({"me_donor": F.coalesce("_d", F.lit(0.0)), "me_acceptor": acceptor_score(F.col("acceptor"), F.col("_t"))}).drop("_k", "_d", "_t")


def wiggled(introns: DataFrame, annotated: DataFrame, by: tuple[int, ...] = config.WIGGLE_SWITCH) -> DataFrame:
    """``introns`` (comp, istart, iend) where an intron beside each, moved by one of ``by`` to either side,
    is in ``annotated``: those are SPLICED and annotated, whatever they were."""
    moves = F.array(*(F.lit(m) for w in by for m in (-w, w)))
    keys = ["comp", "istart", "iend"]
    near = introns.select("comp", "istart", "iend", F.explode(moves).alias("_m")).select("comp", (F.col("istart") + F.col("_m")).alias("istart"), (F.col("iend") + F.col("_m")).alias("iend"))
    hit = near.join(annotated.select(*keys), keys, "left_semi").distinct().withColumn("_hit", F.lit(True))
    x = introns.join(hit, keys, "left")
    return x.withColumns({"is_toga": F.coalesce("_hit", F.lit(False)) | F.col("is_toga"), "support": F.when(F.col("_hit"), "SPLICED").otherwise(F.col("support"))}).drop("_hit")


def nag_shift(introns: DataFrame, contexts: Column, patterns: tuple[str, ...] = config.NAG_PATTERNS) -> DataFrame:
    """Extra introns of annotated AG acceptors whose triplet before (-3) or after (+3) is NAG.

    ``contexts``: struct<acceptor, before, after>. New rows have seen 0, position Unknown, is_nag and support SPLICED.
    """
    x = introns.withColumn("_x", contexts).where("is_toga and _x.acceptor = 'AG'")
    shifts = F.filter(F.array(F.struct(F.lit(-3).alias("by"), F.col("_x.before").alias("t")), F.struct(F.lit(3).alias("by"), F.col("_x.after").alias("t"))), lambda s: s["t"].isin(*patterns))
    return x.withColumn("_s", F.explode(shifts)).withColumns({"iend": F.col("iend") + F.col("_s.by"), "seen": F.lit(0).cast("bigint"), "position": F.lit("Unknown"), "is_nag": F.lit(True), "support": F.lit("SPLICED")}).drop("_x", "_s")


def overlapping_tiles(genome: DataFrame, margin: int) -> DataFrame:
    """(chrom, tile, seq) whose tiles go on for ``margin`` bases of the next one."""
    head = F.substring("seq", 1, margin)
    parts = genome.select("chrom", "tile", F.lit(False).alias("_next"), "seq").unionByName(genome.select("chrom", (F.col("tile") - 1).alias("tile"), F.lit(True).alias("_next"), head.alias("seq")))
    own, more = (F.max(F.when(F.col("_next") == v, F.col("seq"))) for v in (False, True))
    return parts.groupBy("chrom", "tile").agg(F.concat(own, F.coalesce(more, F.lit(""))).alias("seq")).where("seq is not null")


def splice_contexts(introns: DataFrame, genome: DataFrame, tile: int = 65536) -> DataFrame:
    """``introns`` with donor (17 bp), acceptor (23 bp) and both 12 bp template-switch contexts.

    ``genome``: (chrom, tile, seq) with tiles of ``tile`` bases, at least REACH. All windows of an intron end lie
    within REACH of it, so the genome is joined once for each end, with tiles that overlap. A window that leaves
    its chromosome is cut there.
    """
    plus = F.col("strand") == "+"
    s = F.when(plus, F.col("istart") - 1).otherwise(SCALE - F.col("iend") - 1)
    e = F.when(plus, F.col("iend") + 1).otherwise(SCALE - F.col("istart") + 1)
    from strandloom.functions.dna import reverse_complement

    tiles = overlapping_tiles(genome, 2 * REACH)
    x = introns.withColumns({"_s": s, "_e": e})
    for end in ("_s", "_e"):
        x = x.withColumn(f"{end}0", F.greatest(F.col(end) - REACH, F.lit(0))).withColumn("_t", F.floor(F.col(f"{end}0") / tile))
        at = tiles.select("chrom", F.col("tile").alias("_t"), F.col("seq").alias("_q"))
        x = x.join(at, ["chrom", "_t"], "left")
        around = F.substring("_q", (F.col(f"{end}0") - F.col("_t") * tile + 1).cast("int"), F.lit(2 * REACH))
        x = x.withColumn(f"{end}q", F.upper(F.coalesce(around, F.lit("")))).drop("_t", "_q")

    def window(end: str, begin: int, stop: int) -> Column:
        first = F.greatest(F.col(end) + begin, F.lit(0))
        return F.substring(f"{end}q", (first - F.col(f"{end}0") + 1).cast("int"), F.greatest(F.col(end) + stop - first, F.lit(0)).cast("int"))

    windows = {"donor": (("_s", -8, 9), ("_e", -9, 8)), "acceptor": (("_e", -20, 3), ("_s", -3, 20)), "donor_rt": (("_s", -6, 6), ("_e", -6, 6)), "acceptor_rt": (("_e", -6, 6), ("_s", -6, 6))}
    cut = {name: F.when(plus, window(*here)).otherwise(reverse_complement(window(*there))) for name, (here, there) in windows.items()}
    return x.withColumns(cut).drop("_s", "_e", "_s0", "_e0", "_sq", "_eq")
