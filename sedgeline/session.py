"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that decide results (time zone) or plan quality (adaptive execution).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once a session.

    Where executors have it installed this changes nothing; where only the driver can
    import it, functions that run in Python workers need it.
    """
    app, home = spark.sparkContext.applicationId, Path(__file__).parent
    if app in _shipped or not home.is_dir():
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="sedgeline-code-")) / "sedgeline_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, Path(home.name) / f.relative_to(home))
    spark.sparkContext.addPyFile(str(path))


def local_session(cores: int | str | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sedgeline")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def table(spark: SparkSession, base: str, name: str):
    """One table of a directory of Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")
