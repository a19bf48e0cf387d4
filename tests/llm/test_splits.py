import random

from pyspark.sql import functions as F

from sedgeline.llm import splits


def components(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")


def merged(spark, pairs, existing=None):
    return {r.family: r.component for r in splits.merge_components(existing, edges(spark, pairs)).collect()}


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (200, 90)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        pairs = [p for p in pairs if p[0] != p[1]]
        assert merged(spark, pairs) == components(pairs)
    chain = [(i, i + 1) for i in range(70)]
    assert set(merged(spark, chain).values()) == {0}
    star = [(0, i) for i in range(1, 50)]
    assert set(merged(spark, star).values()) == {0}
    assert merged(spark, []) == {}


def test_components_grow(spark):
    first = [(1, 2), (3, 4), (10, 11)]
    table = splits.merge_components(None, edges(spark, first))
    assert merged(spark, [(2, 3), (20, 21)], table) == components([*first, (2, 3), (20, 21)])
    assert merged(spark, [], table) == components(first)


def torn_brute(rows, membership, hex64):
    row_family = {}
    for r in rows:
        row_family.setdefault(hex64(r["row_id"]), set()).add(hex64(r["family_id"]))
    ties = [(hex64(r["family_id"]), f) for r in rows for f in row_family.get(hex64(r["duplicate_of"]), ()) if f != hex64(r["family_id"])]
    comp = components(ties)
    state, present = {}, set()
    for m in membership:
        for f in row_family.get(hex64(m["row_id"]), ()):
            key = m["build_name"], comp.get(f, f)
            state.setdefault(key, set()).add(m["membership"].strip().lower() == "evaluation")
            present.add((m["build_name"], f))
    return {(b, f"sha256:{f}") for b, f in present if len(state[b, comp.get(f, f)]) == 2}


def test_torn_families(tables, hex64):
    rows, a = tables("training_rows")
    membership, b = tables("build_membership")
    assert {tuple(r) for r in splits.torn(rows, membership).collect()} == torn_brute(a, b, hex64)


def h(i):
    return f"sha256:{i:064x}"


MEMBERSHIP = "build_name string, row_id string, membership string, exposure_count int, family string, row string"


def test_edge_cases(spark, training):
    rows = training([
        (1, {"row_id": h(1), "family_id": h(101)}), (2, {"row_id": h(2), "family_id": h(102).upper(), "duplicate_of": h(1)}),
        (3, {"row_id": h(3), "family_id": h(103), "duplicate_of": h(3)}), (4, {"row_id": h(4), "family_id": h(104), "duplicate_of": h(999)}),
        (5, {"row_id": None, "family_id": h(105)}), (6, {"row_id": h(6), "family_id": None, "duplicate_of": h(1)}), (7, {"row_id": h(4), "family_id": h(104)}),
    ])
    member = spark.createDataFrame([("b", h(1), " Evaluation", 1, "x", "y"), ("b", h(2), "full", 1, "x", "y"), ("b", h(3), "full", None, "x", "y"), ("b", h(4), "full", 1, "x", "y"), ("b", h(4), "EVALUATION", 1, "x", "y"), ("b", h(77), "evaluation", 1, "x", "y"), ("c", h(1), None, 1, "x", "y"), (None, h(1), "full", 1, "x", "y"), ("c", None, "full", 1, "x", "y")], MEMBERSHIP)
    assert {tuple(r) for r in splits.torn(rows, member).collect()} == {("b", h(101)), ("b", h(102)), ("b", h(104))}
    assert splits.torn(rows.limit(0), member).count() == 0 and splits.torn(rows, member.limit(0)).count() == 0
    plan = spark.createDataFrame([("b", "Train", 0.5), ("b", "test", 0.5), ("d", "train", 1.0)], "build_name string, split_name string, target_share double")
    got = {(r.build_name, r.family_id): r.split for r in splits.assign(rows, member, plan).collect()}
    assert got["b", h(101)] == got["b", h(102)] == got["b", h(104)] == "quarantine" and got["b", h(103)] == "train"
    assert got["d", h(101)] == got["d", h(102)] == "train" and len(got) == 8
    assert splits.assign(rows, member, plan.limit(0)).count() == 0


def test_shares_are_near_the_plan(tables):
    rows, membership, plan = (tables(n)[0] for n in ("training_rows", "build_membership", "split_plan"))
    assigned = splits.assign(rows, membership.limit(0), plan)
    families = assigned.groupBy("build_name", "family_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    assert families.count() == 0
    for r in splits.shares(rows, assigned, plan).collect():
        assert abs(r.share - r.target_share) < 0.12, r


def test_table_over_time(spark, training, tmp_path):
    table = splits.SplitTable(spark, str(tmp_path / "splits"))
    plan = {"train": 0.8, "test": 0.2}
    first = table.update(training([(i, {"row_id": h(i), "family_id": h(100 + i)}) for i in range(200)]), plan)
    old = {bytes(r.family): r.split for r in first.collect()}
    assert set(old.values()) == {"train", "test"} and 20 <= list(old.values()).count("test") <= 60
    a = next(i for i in range(200) if old[bytes.fromhex(h(100 + i)[7:])] == "train")
    b = next(i for i in range(200) if old[bytes.fromhex(h(100 + i)[7:])] == "test")
    # rows of a later batch: one ties two splits, one joins an existing family, one is new
    batch = training([(300, {"row_id": h(300), "family_id": h(100 + a), "duplicate_of": h(301)}), (301, {"row_id": h(301), "family_id": h(100 + b)}), (302, {"row_id": h(302), "family_id": h(900), "duplicate_of": h(303)}), (303, {"row_id": h(303), "family_id": h(100 + (a + 1 if a + 1 != b else a + 2))})])
    new = {bytes(r.family): r.split for r in table.update(batch, plan).collect()}
    key = lambda i: bytes.fromhex(h(i)[7:])
    assert new[key(100 + a)] == new[key(100 + b)] == "quarantine"
    kept = a + 1 if a + 1 != b else a + 2
    assert new[key(900)] == new[key(100 + kept)] == old[key(100 + kept)]
    assert all(new[f] == s for f, s in old.items() if f not in (key(100 + a), key(100 + b)))
    assert table.version() == 1


def test_table_ties_across_batches(spark, training, tmp_path):
    table = splits.SplitTable(spark, str(tmp_path / "splits"))
    plan = {"train": 0.5, "test": 0.5}
    key = lambda i: bytes.fromhex(h(i)[7:])
    rows = [(i, {"row_id": h(i), "family_id": h(100 + i)}) for i in range(40)]
    waiting = (50, {"row_id": h(50), "family_id": h(150), "duplicate_of": h(60)})
    old = {bytes(r.family): r.split for r in table.update(training([*rows, waiting]), plan).collect()}
    a, b, c = next(i for i in range(40) if old[key(100 + i)] == "train"), next(i for i in range(40) if old[key(100 + i)] == "test"), next(i for i in range(40) if old[key(100 + i)] != old[key(150)])
    # the rows named are in the earlier batch only; row 60 is what row 50 was waiting for
    batch = [(70, {"row_id": h(70), "family_id": h(900), "duplicate_of": h(a)}), (71, {"row_id": h(71), "family_id": h(901), "duplicate_of": h(b)}), (60, {"row_id": h(60), "family_id": h(160)}), rows[a], rows[a]]
    second = {bytes(r.family): r for r in table.update(training(batch), plan).collect()}
    assert second[key(900)].component == second[key(100 + a)].component and second[key(900)].split == "train"
    assert second[key(901)].component == second[key(100 + b)].component and second[key(901)].split == "test"
    assert second[key(160)].component == second[key(150)].component and second[key(160)].split == old[key(150)]
    assert second[key(100 + a)].n == 1 and sum(r.n for r in second.values()) == 44
    # a tie of two rows of earlier batches merges different splits
    third = {bytes(r.family): r for r in table.update(training([(80, {"row_id": h(80), "family_id": h(150), "duplicate_of": h(c)})]), plan).collect()}
    assert {third[key(f)].split for f in (100 + c, 150, 160)} == {"quarantine"}
    assert table.version() == 2


def test_giant_component_is_met_by_broadcast(spark, training, monkeypatch):
    """Chains and stars whose names are hot keys, with the bound at a few rows."""
    monkeypatch.setattr("sedgeline.llm.common.HOT_ROWS", 5)
    monkeypatch.setattr("sedgeline.joins.HOT_ROWS", 5)
    h = lambda n: f"{n:064x}"
    star = [(i, {"row_id": h(i), "family_id": h(1000 + i), "duplicate_of": h(0)}) for i in range(40)]
    chain = [(100 + i, {"row_id": h(100 + i), "family_id": h(2000 + i), "duplicate_of": h(99 + i) if i else None}) for i in range(30)]
    rows = training(star + chain + [(500, {"row_id": h(500), "family_id": h(5000)})])
    got = {bytes(r.family).hex(): bytes(r.component).hex() for r in splits.merge_components(None, splits.ties(rows)).collect()}
    assert got == {h(1000 + i): h(1000) for i in range(40)} | {h(2000 + i): h(2000) for i in range(30)}


def test_versions_hold_changes_only(spark, training, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "WHOLE_EVERY", 3)
    kept = splits.SplitTable(spark, str(tmp_path / "t"))
    h = lambda n: f"{n:064x}"
    plan = {"train": 0.5, "test": 0.5}
    every = []
    for v in range(5):
        # a chain over all batches: each batch names a row of the next one, so ties come late
        every += [(10 * v + k, {"row_id": h(10 * v + k), "family_id": h(100 + 10 * v + k), "duplicate_of": h(10 * v + 10) if k == 0 else None}) for k in range(4)]
        kept.update(training(every[-4:]), plan)
    assert kept.version() == 4
    whole = {bytes(r.family).hex(): (bytes(r.component).hex(), r.n) for r in kept.read().collect()}
    once = {bytes(r.family).hex(): bytes(r.component).hex() for r in splits.merge_components(None, splits.ties(training(every))).collect()}
    assert {f: c for f, (c, _) in whole.items() if f in once} == once and len(whole) == 20 and all(n == 1 for _, n in whole.values())
    assert spark.read.parquet(str(tmp_path / "t/v4/families")).count() < 20
    of = {}
    for r in kept.read().collect():
        of.setdefault(bytes(r.component), set()).add(r.split)
    assert all(len(s) == 1 for s in of.values())
