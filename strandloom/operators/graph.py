"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandloom.workspace import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m"))
    return (
        both.join(least, "src")
        .where(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.least("m", "src").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and digests of them, observed while they are written."""
    seen, h = Observation(), F.xxhash64("src", "dst")
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("s")), "cc")
    return table, tuple(seen.get[k] for k in ("n", "x", "s"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = smallest node reachable.

    Self loops and rows with a null end are ignored; an empty edge table gives an empty result.
    Each round costs a constant number of shuffles on the current edges; hot nodes are spread by
    partial aggregation and by the skew-join rule. Rounds grow with the logarithm of the size.
    """
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
    state, mark = _written(pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(max_rounds):
        if not mark[0]:
            break
        before = mark
        state, mark = _written(_small_star(_large_star(state)))
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("dst").alias("node")).distinct()
    return state.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
