"""5'-end truncation of reads against the consensus starts of references."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import config
from strandloom.functions.coords import INTERVALS, first_exon, middle_exons
from strandloom.operators.intervals import overlap_join, point_join
from strandloom.workspace import materialize


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def consensus_starts(refs: Column) -> Column:
    """struct<starts, middles> from references in order (array of struct<first, middles>).

    While no middle exon is known the first exon is taken; later it is taken if it overlaps none of
    them, or if its start lies in a first exon taken before. Then the reference's middles are added.
    """
    start = F.struct(F.array().cast(INTERVALS).alias("starts"), F.array().cast(INTERVALS).alias("middles"))

    def step(acc: Column, r: Column) -> Column:
        f = r["first"]
        free = ~F.exists(acc["middles"], lambda m: _overlap(f, m))
        inside = F.exists(acc["starts"], lambda s: (f["start"] >= s["start"]) & (f["start"] < s["end"]))
        taken = F.when(free | inside, F.array_union(acc["starts"], F.array(f))).otherwise(acc["starts"])
        return F.struct(taken.alias("starts"), F.array_union(acc["middles"], r["middles"]).alias("middles"))

    return F.aggregate(refs, start, step)


class _Union:
    """Disjoint intervals, kept sorted; intervals that overlap are one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def holds(self, at: int) -> bool:
        i = bisect_right(self.ends, at)
        return i < len(self.starts) and self.starts[i] <= at

    def add(self, start: int, end: int) -> None:
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        j = max(i, j)
        self.starts[i:j], self.ends[i:j] = [start], [end]


def component_starts(refs: DataFrame) -> DataFrame:
    """(comp, start, end): the consensus starts of each component, as ``consensus_starts`` takes them, distinct.

    ``refs``: comp, start, end, name, exons. References come sorted; of a component a task holds the covered
    stretches of its starts and of its middle exons only, searched by bisection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, starts, middles, taken = None, _Union(), _Union(), set()
        for batch in batches:
            out = []
            for of, first, more in zip(*(c.to_pylist() for c in batch.columns)):
                if of != comp:
                    comp, starts, middles, taken = of, _Union(), _Union(), set()
                start, end = first["start"], first["end"]
                if not middles.meets(start, end) or starts.holds(start):
                    if (start, end) not in taken:
                        taken.add((start, end))
                        out.append((of, start, end))
                    starts.add(start, end)
                for m in more:
                    middles.add(m["start"], m["end"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["comp", "start", "end"])

    rows = refs.select(F.col("comp").cast("long").alias("comp"), "start", "end", "name", first_exon(F.col("exons")).alias("first"), middle_exons(F.col("exons")).alias("middles"))
    ordered = rows.repartition("comp").sortWithinPartitions("comp", "start", F.desc("end"), "name")
    return ordered.select("comp", "first", "middles").mapInArrow(run, "comp long, start long, end long")


def verdicts(packed: DataFrame, key: str = "k", recover: bool = False, banned: DataFrame | None = None) -> DataFrame:
    """One row per query: is_truncated, is_novel_start, owner (the smallest middle exon that decides), ratio, recovery and category.

    References are taken in the order start, end descending, name. ``recover`` applies where at least
    half of a component's reads are truncated: then middle exons that fewer than half of its
    references have release their reads. First exons meet starts and middle exons by place, so a deep
    component spreads over its bins.
    """
    refs = packed.where("is_ref")
    middles = refs.select("comp", F.explode(middle_exons(F.col("exons"))).alias("m")).select("comp", F.col("m.start").alias("start"), F.col("m.end").alias("end")).distinct()
    q = packed.where("not is_ref")
    if banned is not None:
        q = q.join(banned.select(key), key, "left_anti")
    x = q.select(key, "comp", first_exon(F.col("exons")).alias("f"))
    firsts = x.select(key, "comp", F.col("f.start").alias("start"), F.col("f.end").alias("end"))
    starts = component_starts(refs).select("comp", F.col("start").alias("ss"), F.col("end").alias("se"))
    complete = point_join(starts, firsts.select(key, "comp", F.col("start").alias("at")), ["comp"], "ss", "se", "at").where("at < se").select(key).distinct().withColumn("complete", F.lit(True))
    met = overlap_join(firsts, middles, ["comp"], closed=True)
    start, end, m0, m1 = (F.col(c) for c in ("start", "end", "r_start", "r_end"))
    own = F.struct(m0.alias("start"), m1.alias("end"))
    met = met.groupBy(key).agg(F.min(F.when((start >= m0) & (start < m1), own)).alias("holder"), F.min(F.when((start < m1) & (m0 < end), own)).alias("toucher"))
    sizes = refs.groupBy("comp").agg(F.count("*").alias("ref_size"))
    x = x.join(complete, key, "left").join(met, key, "left").join(sizes, "comp", "left")
    x = x.withColumns({"complete": F.coalesce("complete", F.lit(False)), "ref_size": F.coalesce("ref_size", F.lit(0))})
    x = x.withColumn("owner", F.when(F.col("complete"), F.col("holder")).otherwise(F.col("toucher")))
    x = x.withColumns({"is_truncated": F.col("owner").isNotNull(), "is_novel_start": ~F.col("complete")})
    x = materialize(x.drop("holder", "toucher"), "truncation")
    ratios = x.groupBy("comp").agg(F.count("*").alias("query_size"), F.avg(F.col("is_truncated").cast("double")).cast("float").alias("ratio"))
    x = x.join(ratios, "comp").withColumn("dirty", F.lit(recover) & (F.col("ratio") >= config.TRUNCATION_THRESHOLD) & F.col("is_truncated"))
    released, support = F.lit(False), F.lit(0.0)
    if recover:
        owners = x.where("owner is not null").select("comp", F.col("owner.start").alias("start"), F.col("owner.end").alias("end")).distinct()
        dirty = x.where("dirty").select(key, "comp", F.col("f.start").alias("start"), F.col("f.end").alias("end"))
        table = overlap_join(dirty, owners, ["comp"]).select(key, "comp", own.alias("o")).join(owner_support(packed), ["comp", "o"], "left").withColumn("support", F.coalesce("support", F.lit(0.0).cast("float")))
        weak = F.col("support") < config.TRUNCATION_RECOVERY_THRESHOLD
        found = table.groupBy(key).agg(F.min_by("support", F.when(weak, F.col("o"))).alias("weak_support"), F.max_by("support", "o").alias("strong_support"), F.bool_or(weak).alias("released"))
        x = x.join(found, key, "left")
        released = F.col("dirty") & F.coalesce("released", F.lit(False))
        support = F.when(released, F.col("weak_support")).when(F.col("dirty"), F.col("strong_support")).otherwise(F.lit(0.0))
    return x.select(
        key, "comp", "is_truncated", "is_novel_start", "ref_size", "query_size", "ratio", F.col("dirty").alias("is_dirty"), (F.col("dirty") & ~released).alias("is_supported"),
        support.cast("float").alias("support_ratio"), F.when(F.col("is_truncated") & ~released, "truncated").otherwise("pass").alias("category"),
    )


def owner_support(packed: DataFrame) -> DataFrame:
    """(comp, o, support): share of a component's references that have exactly this exon."""
    refs = packed.where("is_ref")
    n = refs.groupBy("comp").agg(F.count("*").alias("n"))
    return refs.select("comp", F.explode(F.array_distinct("exons")).alias("o")).groupBy("comp", "o").agg(F.count("*").alias("c")).join(n, "comp").select("comp", "o", (F.col("c").cast("double") / F.col("n")).cast("float").alias("support"))
