import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sedgeline.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def values(spark):
    """values(column function, strings): what the function gives for each string."""
    from pyspark.sql import functions as F

    def run(f, strings, kind="string"):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], f"i int, c {kind}")
        return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]

    return run
