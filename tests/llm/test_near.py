"""Near duplicates and overlaps across splits, against brute force."""

import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sedgeline.llm import common, copies, leaks, neardup, shingles

TRAIN = ("train", "training", "trn")


def similar_brute(records, t=0.6):
    """Pairs of different content with enough common sequences of three words."""
    sets = {}
    for no, text in records:
        if text is not None:
            w = common.masked_words(text)
            sets[no] = (frozenset(zip(w, w[1:], w[2:])), copies.content(text))
    out = set()
    for a, b in combinations(sorted(sets), 2):
        (x, c), (y, e) = sets[a], sets[b]
        if x and y and c != e and len(x & y) / len(x | y) >= t:
            out.add((a, b))
    return out


def found(df, **k):
    rows = [tuple(r) for r in neardup.found(df, **k).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_words():
    assert common.masked_words("１,234.5 Kilos: 3kg, v2 a_b ÉTÉ 7") == ["0", "kilos", "3kg", "v2", "a", "b", "été", "0"]


def test_sequences():
    h, n = shingles.batch_words(["a b c d", None, "", "a b c", "x y"], str.split)
    x, doc = shingles.sequences(h, n, 3)
    assert list(doc) == [0, 0, 3] and x[0] == x[2] != x[1]
    assert len(shingles.sequences(h[:2], n[:1] - 2, 3)[0]) == 0


def test_matches_brute_force(tables):
    inv, rows = tables("inventory")
    want = similar_brute([(r["record_no"], r["canonical_prompt"]) for r in rows])
    assert want and found(inv) == want


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randrange(0, 8)):
        k = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[k] = rng.choice("red green blue 5 77".split())
        elif kind == 1:
            w.insert(k, str(rng.randrange(99)))
        elif kind == 2 and len(w) > 4:
            del w[k]
        else:
            w = w[k:] + w[:k]
    return " ".join(w)


def test_random_edits_and_hot_sequences(inventory, monkeypatch):
    """Blocks of three rows, so that nearly every sequence is hot."""
    monkeypatch.setattr(common, "BLOCK", 3)
    monkeypatch.setattr(common.blocks_of, "__defaults__", (3,))
    monkeypatch.setattr(common.member_pairs, "__defaults__", (None, 3))
    rng = random.Random(3)
    base = [[rng.choice("the a of in on by sun moon star sea hill tree 3 4".split()) for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    texts = [edited(rng, rng.choice(base)) for _ in range(110)]
    records = list(enumerate(texts))
    assert found(inventory([(i, {"canonical_prompt": t}) for i, t in records])) == similar_brute(records)


def test_edge_cases(inventory):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [None, "", "one two", "one two", "a b c 4", "a b c 5", "A, b; c 4!", long, long + " x", "a b c 6", '{"k": "a b c 4"}']
    records = list(enumerate(texts))
    df = inventory([(i, {"canonical_prompt": t}) for i, t in records])
    assert found(df) == similar_brute(records) >= {(4, 5), (5, 9), (7, 8)}
    assert found(df.limit(0)) == set()
    groups = {r.record_no: (r.group_no, r.links) for r in neardup.grouped(df).collect()}
    assert groups[5][0] == groups[4][0] == groups[6][0] == groups[9][0] and groups[8][0] == groups[7][0] == 7
    assert groups[2][0] == groups[3][0] == 2 and groups[7][1] == 1 and 0 not in groups
    assert neardup.grouped(df.limit(0)).count() == 0


def test_frequencies_add_up(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 1],), ([],)], "seqs array<bigint>").repartition(3)
    table = neardup.frequencies(df, 1 << 16)
    assert (table[1], table[2], table[3]) == (3, 1, 1) and table.sum() == 5


def cross_brute(records):
    norm = lambda s: None if s is None else re.sub(r"[\s_-]+", "_", s.strip().lower()) in TRAIN
    side = {r["record_no"]: norm(r["source_split"]) for r in records}
    oid = lambda s: re.sub("[^a-z0-9]", "", re.sub(r"(?<![0-9])0+(?=[0-9])", "", s.lower()))
    keys = {}
    for r in records:
        if r["canonical_prompt"] is not None:
            keys.setdefault(("c", copies.content(r["canonical_prompt"])), []).append(r["record_no"])
        if r["source_id"] and r["original_id"]:
            keys.setdefault(("o", r["source_id"], oid(r["original_id"])), []).append(r["record_no"])
    pairs = {tuple(sorted(p)) for g in keys.values() for p in combinations(sorted(set(g)), 2)}
    pairs |= similar_brute([(r["record_no"], r["canonical_prompt"]) for r in records])
    return {p for p in pairs if side[p[0]] is not None and side[p[1]] is not None and side[p[0]] != side[p[1]]}


def test_across_splits(tables, hex64):
    inv, a = tables("inventory")
    rows, b = tables("training_rows")
    sources, c = tables("source_records")
    got = [tuple(r) for r in leaks.found(inv, rows, sources).collect()]
    assert len(got) == len(set(got))
    want = {("inventory", *p) for p in cross_brute(a)}
    train = lambda s: re.sub(r"[\s_-]+", "_", s.strip().lower()) in TRAIN
    known = {}
    for r in c:
        known[r["source_key"]] = known.get(r["source_key"]) or r["source_split"]
    families = {}
    for r in b:
        if r["source_key"] in known:
            s = known[r["source_key"]] or r["source_key"].split("@")[1].split("/")[1]
            families.setdefault(hex64(r["family_id"]), ([], []))[train(s)].append(r["line_no"])
    want |= {("training_rows", min(x, y), max(x, y)) for e, t in families.values() for x in e for y in t}
    assert want and set(got) == want


def test_across_edge_cases(inventory, training, spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, {"canonical_prompt": "the sun is hot today"}), (2, {"canonical_prompt": "The sun is hot today!", "source_split": "Test"}), (3, {"canonical_prompt": None, "source_split": "dev", "original_id": "O-001"}),
        (4, {"canonical_prompt": None, "original_id": "o1"}), (5, {"canonical_prompt": "", "source_split": None}), (6, {"canonical_prompt": long, "source_split": "eval_external", "original_id": None}),
        (7, {"canonical_prompt": long + " end", "source_id": None}), (8, {"canonical_prompt": "the sun is hot today", "source_split": "odd"}), (9, {"canonical_prompt": "x", "source_split": "val"}), (10, {"canonical_prompt": "x", "source_split": "test"}),
    ]
    df = inventory(rows)
    assert {tuple(r)[1:] for r in leaks.inventory_pairs(df).collect()} == {(1, 2), (1, 3), (3, 4), (6, 7)}
    assert leaks.inventory_pairs(df.limit(0)).count() == 0
    fractions = {r.record_no: r.fraction for r in leaks.overlap_fractions(df).collect()}
    assert fractions[2] == 1.0 and fractions[6] > 0.9 and fractions[9] == 0.0 and 1 not in fractions
    assert leaks.report(df).count() > 0
    t = training([(1, {"family_id": "f", "source_key": "d@r/train/1"}), (2, {"family_id": "F ", "source_key": "d@r/test/a/b"}), (3, {"family_id": None, "source_key": "d@r/test/a/b"}), (4, {"family_id": "f", "source_key": "gone"}), (5, {"family_id": "f", "source_key": None}), (6, {"family_id": "f", "source_key": "odd"}), (7, {"family_id": "f", "source_key": ""})])
    s = spark.createDataFrame([("d@r/train/1", "TRAIN"), ("d@r/train/1", None), ("d@r/test/a/b", None), (None, "test"), ("odd", None), ("", None)], "source_key string, source_split string")
    assert [tuple(r) for r in leaks.row_pairs(t, s).collect()] == [("training_rows", 1, 2)]


def test_hot_key_on_both_sides(spark):
    df = spark.range(900).select("id", F.lit("k").alias("key"), (F.col("id") % 3 == 0).alias("train"))
    assert leaks.across(df, ["key"], ["id"], block=50).distinct().count() == 300 * 600
    assert leaks.across(df.where("train"), ["key"], ["id"], block=50).count() == 0


def test_cut_is_local():
    """An inserted word changes the chunks around it only."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    more = words[:200] + ["new"] + words[200:]
    h, n = shingles.batch_words([" ".join(words), " ".join(more), "", None, "one"], str.split)
    digest, length, doc = leaks.cut(h, n)
    assert length.sum() == 802 and list(np.bincount(doc, weights=length, minlength=5)) == [400, 401, 0, 0, 1]
    a, b = set(digest[doc == 0]), set(digest[doc == 1])
    assert len(a - b) <= 3


def test_report_covers_training_rows(spark, tables):
    rows, sources = tables("training_rows")[0], tables("source_records")[0]
    split = {r.id: r.train for r in leaks.row_splits(rows, sources).collect()}
    hit = {n for r in leaks.row_pairs(rows, sources).collect() for n in (r.a_no, r.b_no) if not split[n]}
    got = leaks.report(tables("inventory")[0], rows, sources).where("record_set = 'training_rows'").collect()
    assert hit and sum(r.overlapping for r in got) == len(hit)
    assert {r.split for r in got} <= {"validation", "test", "external_eval"} and len({(r.source, r.split) for r in got}) == len(got)
    assert sum(r.record_count for r in got) >= sum(not t for t in split.values())


def test_report_of_rows_by_source_and_split(spark, training):
    h = lambda i: f"sha256:{i:064x}"
    sources = spark.createDataFrame([("d@1/train/1", "D_x", "Train"), ("d@1/test/2", "D-x ", "TEST"), ("d@1/test/2", "d x", None), ("e@1/validation/3", "e", None), ("e@1/other/4", "e", None)], "source_key string, dataset string, source_split string")
    rows = training([
        (1, {"family_id": h(1), "source_key": "d@1/train/1"}), (2, {"family_id": h(1).upper(), "source_key": "d@1/test/2"}), (3, {"family_id": h(2), "source_key": "d@1/test/2"}), (4, {"source_key": "d@1/test/2"}),
        (5, {"family_id": h(1), "source_key": "e@1/validation/3"}), (6, {"family_id": h(1), "source_key": "e@1/other/4"}), (7, {"family_id": h(1), "source_key": "none"}),
    ])
    assert {tuple(r) for r in leaks.row_report(rows, sources).collect()} == {("training_rows", "d-x", "test", 3, 1, None), ("training_rows", "e", "validation", 1, 1, None)}


def test_exact_frequencies_give_the_same(tables, monkeypatch):
    """With too few counters for its sequences every one is counted exactly."""
    inv, _ = tables("inventory")
    want = {tuple(r) for r in neardup.found(inv).collect()}
    across = {tuple(r) for r in leaks.inventory_pairs(inv).collect()}
    monkeypatch.setattr(neardup, "LEAST_COUNTERS", 2)
    monkeypatch.setattr(neardup, "MOST_COUNTERS", 2)
    assert want and {tuple(r) for r in neardup.found(inv).collect()} == want
    assert across and {tuple(r) for r in leaks.inventory_pairs(inv).collect()} == across


def test_overlapping_and_classes_agree_with_pairs(tables):
    """Records that come back, by groups and by pairs, with chunks and exactly; links of classes against brute force."""
    inv, _ = tables("inventory")
    split = {r.record_no: r.t for r in inv.select("record_no", common.is_training(F.col("source_split")).alias("t")).collect()}
    table = leaks._chunked_inventory(inv)
    for exact in (False, True):
        pairs = [tuple(r)[1:] for r in leaks.inventory_pairs(inv, exact).collect()]
        got = [r.id for r in leaks.overlapping(inv, table, exact).collect()]
        assert len(got) == len(set(got)) and set(got) == {x for p in pairs for x in p if split[x] is False}
    sets = {r.id: (r.same, r.seqs) for r in table.collect()}
    first = {}
    for no in sorted(sets):
        first.setdefault(sets[no][0], no)
    groups = {}
    for no, (same, seqs) in sets.items():
        groups.setdefault(first[same], (set(seqs), set()))[1].add(split[no])
    like = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.6
    for r in leaks.classes(inv).collect():
        seqs, _ = groups[first[sets[r.record_no][0]]]
        if seqs:
            assert r.class_no == first[sets[r.record_no][0]]
            assert r.links == sum(like(seqs, s) and (not split[r.record_no]) in sides for s, sides in groups.values())
