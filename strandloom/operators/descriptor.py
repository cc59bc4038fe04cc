"""Descriptors: one row of typed columns per read, merged over modules, rendered for files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType


def merge(*modules: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join of descriptor tables by ``key``; columns are the union in the given order."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), modules)


def category(intrapriming: Column, truncated: Column, rt: Column, retention: Column) -> Column:
    """Final category by number of flaws: two or more are trash; a read whose only flaw is truncation has none (null)."""
    flaws = sum((F.coalesce(f, F.lit(False)).cast("int") for f in (intrapriming, truncated, rt, retention)), F.lit(0))
    return F.when(flaws >= 2, "trash").when(rt, "rt").when(intrapriming, "intrapriming").when(retention, "retention").when(flaws == 0, "clean")


def rendered(df: DataFrame) -> DataFrame:
    """All columns as text: null is NULL, arrays are JSON, floats are widened; tabs become three blanks, line feeds one."""

    def text(name: str, kind) -> Column:
        c = F.col(name)
        if isinstance(kind, ArrayType):
            if isinstance(kind.elementType, FloatType):
                c = c.cast(ArrayType(DoubleType()))
            c = F.to_json(c)
        elif isinstance(kind, FloatType):
            c = c.cast("double").cast("string")
        elif not isinstance(kind, StringType):
            c = c.cast("string")
        return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("NULL")), "\t", "   "), "\n", " ").alias(name)

    return df.select(*(text(f.name, f.dataType) for f in df.schema))


def write_tsv(df: DataFrame, path: str) -> None:
    rendered(df).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a read."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_categories(lines: DataFrame, path: str) -> None:
    """(category, line): one folder a category, equal lines once; an empty category makes none."""
    lines.select("category", "line").dropDuplicates().where("category is not null").write.mode("overwrite").partitionBy("category").text(path)
