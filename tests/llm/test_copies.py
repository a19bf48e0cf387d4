import numpy as np
from pyspark.sql import functions as F

from sedgeline.llm import copies


def brute(pairs):
    """(keep, copy) of equal contents, the smallest key kept."""
    by = {}
    for no, c in sorted(pairs):
        if c is not None:
            by.setdefault(c, []).append(no)
    return {(g[0], x) for g in by.values() for x in g[1:] if x > g[0]}


def test_matches_brute_force(tables, hex64):
    inv, a = tables("inventory")
    rows, b = tables("training_rows")
    got = {(r.record_set, r.keep_no, r.copy_no) for r in copies.found(inv, rows).collect()}
    want = {("inventory", *p) for p in brute([(r["record_no"], copies.content(r["canonical_prompt"])) for r in a])}
    want |= {("training_rows", *p) for p in brute([(r["line_no"], hex64(r["canonical_content_hash"])) for r in b])}
    assert got == want and want


def test_content():
    same = [
        ("３ × 4−1 ÷ 2", "3*4-1/2"), ("1,234.5 Metres!", "1234.5metres"), ("A. b", "ab"),
        ('{"given": "b", "context": "a"}', "Context: a\nGiven: b"), ("Context: a | Given: b", "GIVEN: B\ncontext: A."), ('{"a": {"y": 1, "x": [2, "z"]}}', '{"a": {"x": [2, "Z"], "y": 1}}'),
    ]
    for a, b in same:
        assert copies.content(a) == copies.content(b), (a, b)
    for a, b in [("3+4", "3-4"), ("36.8", "368"), ("ab cd", "cd ab"), ("a = b", "a < b"), ("[1, 2]", "[2, 1]"), ("é", "e")]:
        assert copies.content(a) != copies.content(b), (a, b)
    assert copies.content('{"broken": ') == "broken"


def test_edge_cases(inventory, training):
    long = "word " * 200_000
    prompts = [None, "", "  ", "x", "X!", None, long, long.upper(), "y"]
    inv = inventory([(i, {"canonical_prompt": p}) for i, p in enumerate(prompts)] + [(3, {"canonical_prompt": "x"})])
    rows = training([(1, {"canonical_content_hash": "AB" * 32}), (2, {"canonical_content_hash": f" sha256:{'ab' * 32} "}), (3, {"canonical_content_hash": None}), (4, {"canonical_content_hash": "no hash"}), (5, {"canonical_content_hash": "No hash"}), (6, {})])
    got = {(r.record_set, r.keep_no, r.copy_no) for r in copies.found(inv, rows).collect()}
    assert got == {("inventory", 1, 2), ("inventory", 3, 4), ("inventory", 6, 7), ("training_rows", 1, 2), ("training_rows", 4, 5)}
    whole = {(r.record_set, r.keep_no): r.copies for r in copies.collapsed(inv, rows).collect()}
    assert whole["inventory", 3] == 3 and whole["inventory", 8] == 1 and whole["training_rows", 1] == 2 and len(whole) == 6
    assert copies.found(inv.limit(0), rows.limit(0)).count() == 0


def test_many_and_full_filters_lose_nothing(spark, monkeypatch):
    """Small filters grow in number; even those far too small only let more records through to the exact grouping."""
    df = spark.range(500).select(F.lit("s").alias("record_set"), "id", F.encode((F.col("id") % 400).cast("string"), "UTF-8").alias("digest")).repartition(5)
    monkeypatch.setattr(copies, "LEAST_BITS", 64)
    monkeypatch.setattr(copies, "MOST_BITS", 2048)
    assert copies.filter_size(500) == (4, 2048)
    assert copies.copies(df).count() == 100
    repeats, _, singles = copies.groups(df)
    assert repeats.count() + singles.count() == 500 and singles.count() > 200
    assert copies.groups(df, most=10)[0].count() > repeats.count()
    assert copies.copies(df, most=10).count() == 100


def test_filters_grow_with_the_records():
    assert copies.filter_size(0) == (1, copies.LEAST_BITS)
    for n in (10**6, 10**8, 10**10):
        filters, bits = copies.filter_size(n)
        assert filters * bits >= n * copies.BITS_A_RECORD and bits <= copies.MOST_BITS


def test_filter_is_the_union_of_partitions(spark):
    df = spark.range(2000).select(F.encode((F.col("id") % 1500).cast("string"), "UTF-8").alias("digest"), F.lit(0).alias("rng"))
    bits = 1 << 16
    one, seven = (copies.seen_again(df.repartition(n), bits).uri() for n in (1, 7))
    assert np.array_equal(copies._bitmap(one, 0, bits), copies._bitmap(seven, 0, bits))
    assert copies._bitmap(one, 0, bits).any() and not copies._bitmap(one, 5, bits).any()


def test_hot_group(spark):
    """A third of all rows in one group."""
    df = spark.range(30_000).select(F.lit("s").alias("record_set"), "id", F.encode(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")), "UTF-8").alias("digest"))
    got = copies.copies(df)
    assert got.count() == 9_999 and got.where("keep <> 0").count() == 0
