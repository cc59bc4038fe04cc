"""Overlap components of transcripts: pack references and queries, cluster them, filter by mode."""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import coords
from strandloom.operators.graph import connected_components
from strandloom.workspace import materialize

TILE, MOST = 1 << 20, 1 << 20


class Overlap(Enum):
    EXON = "exon"
    CDS = "cds"
    BOUNDARY = "boundary"
    CDS_BOUND = "cds_bound"


class Mode(Enum):
    DEFAULT = "default"
    INTRON = "intron"
    QUERY = "query"
    PAIRED = "paired"
    POLYA = "polya"


def _intervals(tx: DataFrame, overlap: Overlap, key: str) -> DataFrame:
    if overlap is Overlap.BOUNDARY:
        return tx.select(key, "chrom", "strand", "start", "end")
    exons = F.col("exons")
    if overlap is Overlap.CDS:
        exons = coords.clip_cds(exons, F.col("cds_start"), F.col("cds_end"))
    elif overlap is Overlap.CDS_BOUND:
        exons = coords.clip_cds_bound(exons, F.col("cds_start"), F.col("cds_end"))
    return tx.select(key, "chrom", "strand", F.explode(exons).alias("x")).select(key, "chrom", "strand", "x.start", "x.end")


def _ties(key: str, most: int):
    """Rows (key, root) of each tile's intervals, which come sorted by tile and start: root is the smallest key tied to it there.

    After ``most`` intervals a tile goes on as a new one, with the open island's first key in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        tile, first, reach, seen = None, None, 0, 0

        def find(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([find(k) for k in parent], kind)], names=[key, "root"])
            parent.clear()
            return rows

        kind = None
        for batch in batches:
            kind = batch.schema.field(key).type
            for place, k, start, end in zip(zip(*(batch.column(c).to_pylist() for c in ("chrom", "strand", "tile"))), *(batch.column(c).to_pylist() for c in (key, "start", "end"))):
                if place != tile or seen >= most:
                    if parent:
                        yield flush(kind)
                    seen = 0
                    if place != tile:
                        tile, first = place, None
                    elif first is not None:
                        parent[first] = first
                seen += 1
                if first is None or start >= reach:
                    first, reach = k, end
                    parent.setdefault(k, k)
                else:
                    reach = max(reach, end)
                    parent.setdefault(k, k)
                    a, b = find(first), find(k)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        if parent:
            yield flush(kind)

    return run


def components(tx: DataFrame, overlap: Overlap = Overlap.EXON, key: str = "k", tile: int = TILE, most: int = MOST) -> DataFrame:
    """``(key, comp)``: comp is the smallest key of the transcripts that overlap, directly or through others.

    Intervals are copied into the tiles of ``tile`` positions that they meet. A task sweeps its tiles
    from left to right and ties the transcripts of each island; intervals that meet across a tile's end have
    copies in a common tile. A transcript with several tied groups ties these, and only such ties,
    few where tiles are longer than transcripts, go through the rounds of ``connected_components``.
    A task holds the transcripts of ``most`` intervals at a time, however deep a place is. Transcripts
    without an interval (no coding exon) have no component.
    """
    x = _intervals(tx, overlap, key)
    tiles = F.sequence(F.floor(F.col("start") / tile), F.floor(F.greatest(F.col("end") - 1, "start") / tile))
    x = x.withColumn("tile", F.explode(tiles)).repartition("chrom", "strand", "tile").sortWithinPartitions("chrom", "strand", "tile", "start", F.desc("end"))
    kind = x.schema[key].dataType.simpleString()
    ties = x.select("chrom", "strand", "tile", key, "start", "end").mapInArrow(_ties(key, most), f"{key} {kind}, root {kind}")
    by_key = Window.partitionBy(key).orderBy("root")
    seen = Observation()
    ties = ties.select(key, "root", F.first("root").over(by_key).alias("comp"), F.row_number().over(by_key).alias("n")).where("n = 1 or root <> comp")
    ties = materialize(ties.observe(seen, F.count_if(F.col("n") > 1).alias("several")), "ties")
    once = ties.where("n = 1").select(key, "comp")
    if not seen.get["several"]:
        return once
    joined = connected_components(ties.where("n > 1"), "root", "comp")
    return once.join(joined, F.col("comp") == F.col("node"), "left").select(key, F.coalesce("component", "comp").alias("comp"))


def gene_exons(refs: DataFrame, gene: str = "gene") -> DataFrame:
    """(comp, gene, exons): the distinct exons of a gene's references in a component, sorted."""
    x = refs.select("comp", gene, F.explode("exons").alias("x"))
    return x.groupBy("comp", gene).agg(F.array_sort(F.collect_set("x")).alias("exons"))


def merged_genes(refs: DataFrame, gene: str = "gene") -> DataFrame:
    """(comp, n_genes, merged): the genes of a component's references, and one name of all of them."""
    genes = refs.groupBy("comp").agg(F.array_sort(F.collect_set(gene)).alias("g"))
    return genes.select("comp", F.size("g").cast("long").alias("n_genes"), F.array_join("g", ".").alias("merged"))


def pack(tx: DataFrame, overlap: Overlap = Overlap.EXON, mode: Mode = Mode.DEFAULT, key: str = "k") -> DataFrame:
    """``tx`` with ``comp``, ``n_refs`` and ``n_queries``; modes QUERY, INTRON and POLYA drop components that lack a side."""
    by = Window.partitionBy("comp")
    packed = tx.join(components(tx, overlap, key), key).withColumns({"n_refs": F.count_if("is_ref").over(by), "n_queries": F.count_if(~F.col("is_ref")).over(by)})
    if mode is Mode.QUERY:
        return packed.where("n_refs > 0 and n_queries > 0")
    if mode in (Mode.INTRON, Mode.POLYA):
        return packed.where("n_refs > 0")
    return packed
