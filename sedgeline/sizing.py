"""Broadcasts only of what was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.scratch import store

#: Rows, and bytes of their values, up to which a side of a join is broadcast.
MOST_ROWS, MOST_BYTES = 200_000, 64 << 20


def file_bytes(spark, path: str) -> int:
    """Bytes of the files below a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def small(df: DataFrame, rows: int = MOST_ROWS, most: int = MOST_BYTES) -> DataFrame:
    """df, written once and marked for broadcast if it has at most so many rows and bytes of values, else
    as it is stored, for a shuffle join.

    What df is made from runs once. Files beyond ``most`` bytes are not looked into.
    """
    kept = store(df, "side")
    if file_bytes(df.sparkSession, kept.path) > most:
        return kept.df
    n = kept.df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(kept.df) if n.n <= rows and n.b <= most else kept.df
