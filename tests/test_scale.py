"""Bounds, hot groups and failures of the core operators."""

import pytest
from pyspark.sql import functions as F

from sedgeline import scratch, sizing
from sedgeline.functions import answers
from sedgeline.operators import neighbors, ordinal, registry, rules, scoring, selection


def test_small_measures_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in df._jdf.queryExecution().logical().toString()
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("wide"))
    assert hinted(sizing.small(df))
    assert not hinted(sizing.small(df, rows=9)) and not hinted(sizing.small(df, most=5000))
    assert sizing.small(df, rows=9).count() == 10


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        applicationId, master = "app-cluster", "spark://host:7077"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.root(Session)


def test_ordinals_in_groups_and_running_totals(spark):
    rows = [(None if g == 3 else g, k) for g in range(4) for k in range(50 if g == 1 else 3)]
    df = spark.createDataFrame(rows, "g int, k int").repartition(7)
    got = ordinal.with_ordinal_by(df, ["g"], F.col("k").desc()).collect()
    assert sorted((r.g is None, r.g, r.k, r.ordinal) for r in got) == sorted((g is None, g, k, (49 if g == 1 else 2) - k) for g, k in rows)
    run = ordinal.with_running(spark.range(100).repartition(9), ["id"], total="id").collect()
    assert {r.id: r.total for r in run} == {i: i * (i + 1) // 2 for i in range(100)}
    assert ordinal.with_ordinal_by(df.limit(0), ["g"], "k").count() == 0
    ids = spark.createDataFrame([(7,), (123456,)], "ordinal long").select(ordinal.ordinal_id("a").alias("v")).collect()
    assert [r.v for r in ids] == ["a_00007", "a_123456"]


def test_medians(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), (None, 5.0), ("c", None)], "g string, v double")
    got = {r.g: (r.runs, r["median"]) for r in scoring.repeated_runs(df, "v", "g").collect()}
    assert got == {"a": (3, 2.0), "b": (2, 5.0), None: (1, 5.0), "c": (0, None)}


def test_pareto_in_blocks(spark):
    # an anti-chain, larger than a block, with what it beats, ties and a null
    rows = [(i, 50 - i) for i in range(50)] + [(i, 40 - i) for i in range(40)] + [(0, 50), (None, 99)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    want = sorted([(i, 50 - i) for i in range(50)] + [(0, 50)])
    assert sorted(map(tuple, scoring.pareto(df, ["a", "b"], [], rows=7).collect())) == want
    assert scoring.pareto(df.limit(0), ["a"], ["b"]).count() == 0


def test_neighbors_of_vectors_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERIES_A_BLOCK", 1)
    q = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0])]
    rows = spark.createDataFrame([(10, [1.0, 0.1]), (11, [1.0, 0.0, 0.1]), (12, [0.0, 1.0]), (13, None), (14, [None, 1.0])], "vec_id long, embedding array<float>")
    want = {(1, 10), (1, 12), (2, 11)}
    for order in (q, q[::-1]):
        got = neighbors.cosine_neighbors(spark.createDataFrame(order, rows.schema), rows, 5).collect()
        assert {(r.query_id, r.neighbor_id) for r in got} == want


def _batch(spark, source="k", row="r"):
    s = spark.createDataFrame([(source, "d", "v", "train", "1", None)], "source_key string, dataset string, revision string, source_split string, original_id string, raw_record_hash string")
    r = spark.createDataFrame([(row, f"f{row}", source, "solve", "c", "v1", "h", "t", "accepted")], "row_id string, family_id string, source_key string, selected_behavior string, constraint_signature string, renderer_version string, canonical_content_hash string, template_fingerprint string, status string")
    return {"source_records": s, "training_rows": r.withColumn("duplicate_of", F.lit(None).cast("string"))}


def test_a_batch_that_fails_between_tables_leaves_the_registry(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert registry.append(spark, root, _batch(spark)) == {"source_records": 1, "training_rows": 1}
    bad = _batch(spark, "k2", "r2")

    class Breaks:
        """A table whose write fails after the one before it was written."""

        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            if name == "write":
                raise OSError("disk lost")
            return getattr(self.df, name)

    real = registry.with_defaults
    try:
        registry.with_defaults = lambda df, table, now=None: real(df, table, now) if table != "training_rows" else Breaks(real(df, table, now))
        with pytest.raises(Exception):
            registry.append(spark, root, bad)
    finally:
        registry.with_defaults = real
    assert registry.read(spark, root, "source_records").count() == 1
    assert registry.append(spark, root, bad) == {"source_records": 2, "training_rows": 2}
    with pytest.raises(ValueError, match="training_rows_key"):
        registry.append(spark, root, _batch(spark, "k3", "r2"))
    with pytest.raises(ValueError, match="row_id_present"):
        registry.append(spark, root, _batch(spark, "k3", None))
    # damaged files are an error, not an empty registry
    for f in (tmp_path / "registry" / "b0" / "training_rows").glob("part-*"):
        f.write_bytes(b"damaged")
    with pytest.raises(Exception):
        registry.append(spark, root, _batch(spark, "k4", "r"))


def test_number_words(spark):
    texts = ["twenty-one", "two hundred and five cats", "TWELVE thousand", "a hundred and twelve", "ninety one", "one million two thousand three", "twelve"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    find = lambda v: {r.i for r in df.where(answers.mentions_number(F.col("t"), F.lit(v))).collect()}
    assert find("21") == {0} and find("205") == {1} and find("12000") == {2} and find("12") == {6} and find("91") == {4} and find("1002003") == {5}
    assert find("1") == set() and find("5") == set() and find("20") == set() and find("90") == set() and find("200") == set()


def test_representatives_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(6000)] + [("few", 1), ("few", 2), (None, 3)]
    df = spark.createDataFrame(rows, "g string, k int")
    out = selection.representatives(df, ["g"], "k", [F.col("k").desc()])
    got = {(r.g, r.retained, r.is_duplicate): r["count"] for r in out.groupBy("g", "retained", "is_duplicate").count().collect()}
    assert got == {("hot", 5999, True): 5999, ("hot", 5999, False): 1, ("few", 2, True): 1, ("few", 2, False): 1, (None, None, None): 1}


def test_caps_and_controller(spark):
    rows = [(i, "c", "t" if i < 8 else "u") for i in range(12)]
    df = spark.createDataFrame(rows, "k int, cell string, topic string")
    got = {r.k for r in selection.within_caps(df, ["cell"], F.lit(6), {"topic": 0.5}, [F.col("k")]).collect()}
    assert got == {0, 1, 2, 8, 9, 10}
    rows = spark.createDataFrame([(1, "c", ["a", "b"]), (2, "c", ["a"]), (3, "c", None), (4, "c", ["b", "a"])], "k int, cell string, options array<string>")
    targets = spark.createDataFrame([("c", "a", 2), ("c", "b", 2)], "cell string, option string, target int")
    got = {r.k: r.option for r in selection.quota_controller(rows, targets, "k", "cell", "options", [F.col("k")]).collect()}
    assert got == {1: "b", 2: "a", 4: "b"}
    assert selection.quota_controller(rows, targets.limit(0), "k", "cell", "options", [F.col("k")]).count() == 0


def test_unknown_paths_and_stripping(spark):
    raw = '{"a": {"b": " x ", "z": 1}, "l": [{"c": " y"}, {"q": 2}], "m": {"k": {"d": 1, "w": 1}}, "y": 0}'
    schema = "a struct<b string>, l array<struct<c string>>, m map<string,struct<d int>>"
    df = spark.createDataFrame([(1, raw), (2, "[]"), (3, None), (4, "{}")], "i int, raw string")
    got = {r.i: r for r in rules.strict(df, "raw", schema).collect()}
    assert sorted(got[1].unknown) == ["a.z", "l[].q", "m{}.w", "y"] and got[1].a.b == "x" and got[1].l[0].c == "y"
    assert got[2].malformed and got[3].malformed and not got[4].malformed and got[4].unknown == []
