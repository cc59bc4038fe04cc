"""Interval operators: islands, overlap joins by bins of several lengths, blacklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", out: str = "island", tile: int = 1 << 20) -> DataFrame:
    """Number the maximal chains of overlapping intervals (strict: touching ones do not join) within ``by``.

    Intervals are sorted within tiles of ``tile`` positions only. What reaches into a tile from the
    left, and how many islands open before it, are running values over one row a tile.
    """
    keys = [*by, "_tile"]
    tiled = rows.withColumn("_tile", F.floor(F.col(start) / tile))
    left_of = Window.partitionBy(*by).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tops = tiled.groupBy(*keys).agg(F.max(end).alias("_top")).select(*keys, F.max("_top").over(left_of).alias("_reach"))
    order = Window.partitionBy(*keys).orderBy(F.col(start), F.col(end).desc())
    before = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    marked = tiled.join(tops, keys, "left").withColumn("_opens", F.when(before.isNull() | (F.col(start) >= before), 1).otherwise(0))
    opened = marked.groupBy(*keys).agg(F.sum("_opens").alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(left_of), F.lit(0)).alias("_base"))
    number = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_base")
    return marked.join(opened, keys, "left").withColumn(out, number.cast("bigint")).drop("_tile", "_reach", "_opens", "_base")


#: Bins of level l have 2^(FIRST_BITS + l * STEP_BITS) positions; an interval stands on the first level whose bins are as long.
FIRST_BITS, STEP_BITS, LEVELS = 12, 6, 3


def _level(start: str, end: str) -> Column:
    length = F.col(end) - F.col(start)
    level = F.lit(LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        level = F.when(length < (1 << FIRST_BITS + n * STEP_BITS), n).otherwise(level)
    return level


def _bin(at: str, level: str = "_level") -> Column:
    return F.expr(f"shiftright({at}, {FIRST_BITS} + {STEP_BITS} * {level})")


def point_join(spans: DataFrame, points: DataFrame, by: list[str], start: str, end: str, at: str) -> DataFrame:
    """Pairs of a span and a point ``at`` within [start, end], as an equi-join on ``by``, level and bin.

    A span stands in at most two bins of its level (of the last one in as many as it needs), a point in one
    of each level, however long the spans are. A hot key spreads over its bins; a hot bin is split by the skew-join rule.
    """
    binned = spans.withColumn("_level", _level(start, end)).withColumn("_bin", F.explode(F.sequence(_bin(start), _bin(end))))
    probes = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("_bin", _bin(at))
    return binned.join(probes, [*by, "_level", "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_level", "_bin")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], closed: bool = False) -> DataFrame:
    """Pairs of overlapping half-open intervals: ``left`` columns, then ``right`` columns prefixed ``r_``.

    Both sides have ``start`` and ``end``. An interval stands in the bins of its level and of all longer
    levels, at most two each; a pair is emitted once, on the longer one's level and in the later of the two first
    bins there, so that it stays an equi-join. Two intervals meet only where one of them is on its own level, the
    left one in turn 0 and the right one in turn 1: short ones never meet by the wide bins of long ones. ``closed``:
    touching intervals meet too.
    """

    def binned(d: DataFrame, start: str, end: str, level: str, place: str) -> DataFrame:
        own = d.withColumn(f"{level}_own", _level(start, end))
        levels = own.withColumn(level, F.explode(F.sequence(F.col(f"{level}_own"), F.lit(LEVELS - 1))))
        return levels.withColumn(place, F.explode(F.sequence(_bin(start, level), _bin(end, level))))

    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    a, b = binned(left, "start", "end", "_level", "_bin"), binned(r, "r_start", "r_end", "_rlevel", "_rbin")
    a = a.withColumn("_turn", F.when(F.col("_level") == F.col("_level_own"), 0).otherwise(1))
    # in turn 1 the left one is shorter than the level's
    turns = F.when((F.col("_rlevel") == F.col("_rlevel_own")) & (F.col("_rlevel") > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = b.withColumn("_rturn", F.explode(turns))
    keys = [F.col(c) == F.col(f"r_{c}") for c in by] + [F.col("_turn") == F.col("_rturn"), F.col("_level") == F.col("_rlevel"), F.col("_bin") == F.col("_rbin")]
    hit = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    if closed:
        hit = (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end"))
    once = (F.col("_level") == F.greatest("_level_own", "_rlevel_own")) & (F.col("_bin") == F.greatest(_bin("start"), _bin("r_start", "_rlevel")))
    return a.join(b, keys).where(hit & once).drop("_turn", "_rturn", "_level", "_bin", "_rlevel", "_rbin", "_level_own", "_rlevel_own")


def sharing(rows: DataFrame, key: str, on: list[str]) -> DataFrame:
    """(a, b), a < b: the pairs of ``key`` that have a row in common by ``on``."""
    x = rows.select(key, *on).distinct()
    return x.withColumnRenamed(key, "a").join(x.withColumnRenamed(key, "b"), on).where("a < b").select("a", "b").distinct()


def without_names(rows: DataFrame, banned: DataFrame) -> DataFrame:
    """Rows whose name is not in a blacklist of names."""
    return rows.join(banned.select("name").distinct(), "name", "left_anti").select(rows.columns)


def without_intervals(rows: DataFrame, banned: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose interval is none of a blacklist (chrom, start, end) of intervals."""
    b = banned.select("chrom", F.col("start").alias(start), F.col("end").alias(end)).distinct()
    return rows.join(b, ["chrom", start, end], "left_anti").select(rows.columns)
