"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet into ``spark.checkpoint.dir`` and reading it
again: the files outlive any executor, are columnar, and later reads prune
columns. Only where that setting is absent and all of Spark runs on this machine (tests) a
temporary folder takes its place; on a cluster its absence is an error, as executors would
each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_roots: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the files are then the cluster's to clean
        pass


def root(spark: SparkSession) -> str:
    """The session's own folder below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get(_SETTING, None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='sedgeline-')}"
        _roots[app] = f"{base.rstrip('/')}/sedgeline-{app}"
        atexit.register(_delete, spark, _roots[app])
    return _roots[app]


class Stored:
    """A written table; ``drop`` deletes it once nothing will read it again."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def drop(self) -> None:
        _delete(self.df.sparkSession, self.path)

    def uri(self) -> str:
        """The path as Python workers know it."""
        spark = self.df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
        return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole.replace("s3a://", "s3://", 1)


def read_part(uri: str, column: str, value, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """In a Python worker: the batches of one part of a table stored ``by`` a column; none if there is no such part."""
    from pyarrow import dataset, fs

    system, path = fs.FileSystem.from_uri(f"{uri}/{column}={value}")
    if system.get_file_info(path).type != fs.FileType.NotFound:
        yield from dataset.dataset(path, filesystem=system, format="parquet").to_batches(columns=columns)


def store(df: DataFrame, name: str, by: str | None = None) -> Stored:
    """Write a DataFrame to the shared folder and read it back, lineage cut. by: a column by whose values
    the files are divided, so that rows of one value lie together."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``store``, for tables that live until the session ends."""
    return store(df, name).df
