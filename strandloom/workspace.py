"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it back; a lost
executor then costs a re-read, not a re-run. Where that setting is absent (tests, local mode)
a folder below the warehouse is used.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, set here only where the session names none."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    The table is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def as_scan(df: DataFrame, name: str) -> DataFrame:
    """``df`` if each task gives its rows in one order whenever it runs, as scans and what keeps rows in
    place do; else a scan of a table written from it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = set(re.findall(r"^[\s:+-]*([A-Za-z]+)", plan, re.MULTILINE))
    return df if nodes <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD"} else materialize(df, name)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
