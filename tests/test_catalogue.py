"""Every query runs at the smallest scale and equals its SQL."""

import datetime
import math
import os

import duckdb
import pytest

from sedgeline import scratch
from sedgeline.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_firewall_decisions_knows_all_spellings(spark, tmp_path):
    rows = [
        (1, "Validation", "What is one and one?"), (2, "test", "Name the largest planet."), (3, "external-eval", "Why is the sky blue?"),
        (4, "TRAIN", "What is one and one?"), (5, "train ", "Name the largest planet."), (6, "trn", "Why is the sky blue?"), (7, "training", "A question of its own."), (8, None, "What is one and one?"),
    ]
    spark.createDataFrame(rows, "record_no long, source_split string, canonical_prompt string").write.parquet(f"{tmp_path}/inventory.parquet")
    spark.createDataFrame([(1, "Another held-out text entirely")], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {r.allowed: r.row_count for r in catalogue.QUERIES["firewall_decisions"](spark, str(tmp_path)).collect()}
    assert got == {True: 1, False: 3}


def test_census_rejects_frozen_prompts(spark, data):
    counts = {r[0]: r[1] for r in catalogue.QUERIES["reason_counts"](spark, data).collect()}
    assert counts["exact_eval_overlap"] > 0 and counts["template_eval_overlap"] > 0


def test_answers_and_hints_of_full_width_digits(spark, tmp_path):
    spark.createDataFrame([(1, "Add ３ and ４"), (2, "Add 5 and 6"), (3, "No number")], "record_no long, canonical_prompt string").write.parquet(f"{tmp_path}/inventory.parquet")
    got = {r.record_no: r.answer for r in catalogue.QUERIES["answer_extract"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[2] == "6" and got[1] in ("4", "４") and got[3] == "number"
    got = {r.record_no: r.hint for r in catalogue.QUERIES["hints"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[1].startswith("Combine ") and got[3].startswith("Name ")


def test_wrong_answers_of_decimals(spark, tmp_path):
    spark.createDataFrame([(1, "so #### 2.5"), (2, "so #### 7"), (3, "so #### 0")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.wrong for r in catalogue.QUERIES["wrong_answers"](spark, str(tmp_path)).collect()}
    assert got == {1: "3.5", 2: "8", 3: "-1"}


@pytest.mark.parametrize("kind", ["{}", "file:{}", "file://{}", "viewfs://sedgeline{}"])
def test_sqlite_rows_on_a_cluster_with_any_shared_folder(spark, data, duck, tmp_path, monkeypatch, kind):
    folder = tmp_path / "a folder#1 of 50%?"
    folder.mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.sedgeline.link.{tmp_path}", f"file://{tmp_path}")
    monkeypatch.setattr(scratch, "root", lambda _: kind.format(folder))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    got = sorted(tuple(r) for r in catalogue.QUERIES["sqlite_rows"](spark, data).collect())
    assert got == sorted(duck.execute(catalogue.ORACLE_SQL["sqlite_rows"]).fetchall())
    assert len(list(folder.glob("items-*.sqlite"))) == 1
