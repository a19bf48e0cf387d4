import re

import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def tables(spark, data):
    """tables(name): (DataFrame, rows as dictionaries)."""

    def get(name):
        path = f"{data}/{name}.parquet"
        return spark.read.parquet(path), pq.read_table(path).to_pylist()

    return get


@pytest.fixture(scope="session")
def hex64():
    def f(s):
        m = re.search("[0-9a-f]{64}", (s or "").lower())
        return m and m[0]

    return f


INVENTORY = "record_no long, source_id string, original_id string, canonical_prompt string, source_split string, subject string, eligible_behaviors array<string>, license_class string, id long, digest string, n long, train string, same string"
ROWS = "line_no long, row_id string, family_id string, source_key string, canonical_content_hash string, duplicate_of string, id long, key string, row string, component string, n int"


@pytest.fixture(scope="session")
def inventory(spark):
    """inventory([(record_no, {column: value})]): an inventory with extra columns of clashing names."""
    names = [c.split()[0] for c in INVENTORY.split(", ")]

    def make(rows):
        base = {"source_id": "s", "source_split": "train", "eligible_behaviors": ["solve"], "license_class": "x", "subject": "math", "id": -1, "digest": "d", "n": 7, "train": "t", "same": "s"}
        return spark.createDataFrame([tuple((base | {"original_id": f"o{no}"} | values | {"record_no": no}).get(c) for c in names) for no, values in rows], INVENTORY)

    return make


@pytest.fixture(scope="session")
def training(spark):
    names = [c.split()[0] for c in ROWS.split(", ")]

    def make(rows):
        base = {"id": 1, "key": "k", "row": "r", "component": "c", "n": 3}
        return spark.createDataFrame([tuple((base | {"line_no": no} | values).get(c) for c in names) for no, values in rows], ROWS)

    return make
