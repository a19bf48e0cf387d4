"""Mixes and samples."""

import random

from pyspark.sql import functions as F

from sedgeline.llm import budgets, mixing, sampling


def test_thresholds(spark):
    rng = random.Random(2)
    items = [(c, rng.randrange(1 << 30), rng.randrange(0, 50)) for c in ("a", "b") for _ in range(3000)]
    whole = {c: sum(s for k, _, s in items if k == c) for c in "ab"}
    lines = [("1", "a", 1000.0), ("2", "a", 20_000.0), ("3", "a", whole["a"] + 1.0), ("4", "b", 0.0), ("5", "none", 10.0), ("6", "b", -5.0), ("7", "b", float(whole["b"]))]
    got = {r.line: r.threshold for r in budgets.thresholds(spark.createDataFrame(items, "cell string, h long, size int"), spark.createDataFrame(lines, "line string, cell string, budget double")).collect()}
    for line, cell, budget in lines:
        inside = sorted((h, s) for k, h, s in items if k == cell)
        taken = sum(s for h, s in inside if h < got[line])
        assert taken <= max(0, budget), line
        after = [s for h, s in inside if h >= got[line] and s > 0]
        assert not after or taken + after[0] > budget, line
    assert got["1"] < got["2"] < got["3"] == 1 << 30


def mix_tables(spark, inventory):
    sources = spark.createDataFrame([("s", " D/One", "open", 1), ("t", "d/one", "closed", 1), ("u", "d_two", None, 1)], "id string, dataset string, license_class string, record_no int")
    inv = inventory([(i, {"source_id": "s", "canonical_prompt": "x" * 10, "license_class": "zzz"}) for i in range(100)] + [(200, {"source_id": "t", "canonical_prompt": None}), (201, {"source_id": "gone", "canonical_prompt": "y"}), (202, {"source_id": "u", "canonical_prompt": "y" * 50}), (203, {"source_id": None, "canonical_prompt": "y"})])
    plan = spark.createDataFrame(
        [("m", "D/ONE ", "open", 0.5, 2, 1000), ("m", "d/one", "closed", 0.1, 3, 1000), ("m", "D-TWO", None, 0.3, 4, 1000), ("n", "d/one", "open", 0.3, 9, 5000), ("n", "none", "open", 0.2, 1, 1000), ("o", "d/one", "open", None, 1, 1000), ("o", "d/one", "open", 0.1, None, 1000)],
        "mix_name string, dataset string, license_class string, target_share double, max_repeats int, mix_chars long",
    )
    return plan, inv, sources


def test_mix(spark, inventory):
    t = mix_tables(spark, inventory)
    assert {tuple(r) for r in mixing.found(*t).collect()} == {("m", "d/one"), ("m", "d-two"), ("n", "none")}
    got = {(r.mix_name, r.dataset, r.license_class): r for r in mixing.shares(*t).collect()}
    assert got["m", "d/one", "open"].chars == 500 and got["n", "d/one", "open"].chars == 1500
    assert got["m", "d-two", None].chars == 200 and got["m", "d-two", None].short and not got["m", "d/one", "open"].short
    drawn = mixing.draw(*t)
    n = drawn.where("mix_name = 'n' and dataset = 'd/one'").groupBy("repeats").agg(F.count("*").alias("n"))
    assert {r.repeats: r.n for r in n.collect()} == {1: 50, 2: 50}
    small = {r.record_no for r in drawn.where("mix_name = 'm' and dataset = 'd/one'").collect()}
    large = {r.record_no for r in drawn.where("mix_name = 'n' and repeats = 2").collect()}
    assert small == large and len(small) == 50  # of equal rests the same records
    assert mixing.draw(*t).where("repeats > 4").count() == 0
    assert mixing.found(t[0].limit(0), t[1], t[2]).count() == 0 and mixing.found(t[0], t[1].limit(0), t[2]).count() == 5
    assert mixing.shares(t[0], t[1].limit(0), t[2]).agg(F.sum("chars")).first()[0] == 0


def test_mix_reaches_targets(tables):
    plan, inv, src = (tables(n)[0] for n in ("mix_plan", "inventory", "sources"))
    for r in mixing.shares(plan, inv, src).collect():
        if not r.short:
            assert abs(r.share - r.target_share) <= 0.03 * max(1, r.target_share) and r.share <= r.target_share + 1e-6


PLAN = "sample_name string, subject string, behavior string, target_share double, sample_size long"
CELLS = "subject string, behavior string, minimum_examples int, id string"


def sample_tables(spark, inventory):
    rows = [(i, {"subject": "Math " if i % 2 else "mathematics", "eligible_behaviors": ["solve", "solve", "explain"]}) for i in range(300)]
    rows += [(1000 + i, {"subject": "physics", "eligible_behaviors": ["solve"]}) for i in range(40)]
    rows += [(2000, {"subject": None}), (2001, {"eligible_behaviors": None}), (2002, {"eligible_behaviors": []}), (2003, {"subject": "physics", "eligible_behaviors": [None, "hint"]})]
    plan = spark.createDataFrame([("s", "math", "solve", 0.4, 100), ("s", "math", "explain", 0.2, 100), ("s", "physics", "solve", 0.4, 100), ("s", "physics", "hint", None, 100), ("t", "math", "solve", 2.0, 50), ("t", "biology", "solve", 0.5, 50)], PLAN)
    cells = spark.createDataFrame([("math", "explain", 30, "x"), ("physics", "hint", 3, "x"), ("physics", "solve", 10, "x")], CELLS)
    return plan, cells, inventory(rows)


def test_sample(spark, inventory):
    t = sample_tables(spark, inventory)
    assert {tuple(r) for r in sampling.found(*t).collect()} == {("s", "physics", "hint"), ("t", "biology", "solve")}
    sample = sampling.draw(*t)
    assert sample.groupBy("sample_name", "record_no").count().where("count > 1").count() == 0
    got = {(r.sample_name, r.subject, r.behavior): r for r in sampling.gaps(*t).collect()}
    assert got["s", "math", "solve"].drawn == 40 and got["s", "math", "explain"].drawn >= 30 and got["s", "physics", "solve"].drawn == 40
    assert got["s", "physics", "hint"].drawn == 1 and got["s", "physics", "hint"].missing == 2 and got["t", "biology", "solve"].missing == 25
    assert sampling.found(t[0], t[1].limit(0), t[2].limit(0)).count() == 5 and sampling.draw(t[0], t[1], t[2].limit(0)).count() == 0
    assert sampling.draw(t[0].limit(0), t[1], t[2]).count() == 0


def test_found_comes_through_the_draw(spark, inventory, monkeypatch):
    ran = []
    for module, step in ((sampling, "rake"), (sampling, "_state"), (budgets, "thresholds"), (sampling, "exchange")):
        monkeypatch.setattr(module, step, lambda *a, f=getattr(module, step), step=step: (ran.append(step), f(*a))[1])
    t = sample_tables(spark, inventory)
    assert {tuple(r) for r in sampling.found(*t).collect()} == {("s", "physics", "hint"), ("t", "biology", "solve")}
    assert set(ran) == {"rake", "_state", "thresholds", "exchange"}


def test_found_in_odd_plans(spark, inventory):
    plan, cells, inv = sample_tables(spark, inventory)
    inf = float("inf")
    odd = [("s", "Maths", "solve", 0.4, 100), ("s", "math", "solve", 9.0, 100), (None, "math", "solve", 0.4, 100), (None, "math", "explain", 0.9, 100), (None, "physics", "solve", 0.5, 100), ("u", "math", "solve", float("nan"), 100), ("u", "math", "explain", -1.0, 100), ("u", "physics", "solve", inf, 100), ("u", "physics", "hint", 0.1, None), ("u", None, "solve", 0.1, 100), ("u", "math", None, 0.1, 100)]
    all_ = plan.union(spark.createDataFrame(odd, PLAN))
    have = {("math", "solve"): 300, ("math", "explain"): 300, ("physics", "solve"): 40, ("physics", "hint"): 1}
    least = {("math", "explain"): 30, ("physics", "hint"): 3, ("physics", "solve"): 10}
    want = []
    for name, subject, behavior, share, size in (tuple(r) for r in all_.collect()):
        cell = (subject and subject.lower().replace("maths", "math"), behavior)
        target = (share or 0.0) * (size or 0)
        if target != target or have.get(cell, 0) < max(least.get(cell, 0), target):
            want.append((name, *cell))
    assert sorted((tuple(r) for r in sampling.found(all_, cells, inv).collect()), key=str) == sorted(want, key=str)
    assert sampling.draw(all_, cells, inv).groupBy("sample_name", "record_no").count().where("count > 1").count() == 0


def test_rake_moves_what_a_cell_lacks():
    line = lambda s, b, share, supply: {"subject": s, "behavior": b, "share": share, "sample_size": 100, "supply": supply}
    got = sampling.rake([line("m", "x", 0.25, 10), line("m", "y", 0.25, 500), line("p", "x", 0.25, 500), line("p", "y", 0.25, 500)])
    assert got["m", "x"] == 10 and got["m", "y"] > 25 and got["p", "x"] > 25 and sum(got.values()) <= 100.001


def test_sample_is_near_its_targets(tables):
    plan, cells, inv = (tables(n)[0] for n in ("sample_plan", "balanced_tutoring_v8", "inventory"))
    lacking = {(r.sample_name, r.subject, r.behavior) for r in sampling.found(plan, cells, inv).collect()}
    for r in sampling.gaps(plan, cells, inv).collect():
        if (r.sample_name, r.subject, r.behavior) not in lacking:
            assert r.missing <= 3, r


def met_brute(counts, least):
    """The most records that count for the minimums, over all ways to give records to cells."""
    records = [k for (k, _), n in counts.items() for _ in range(n)]
    reached = {tuple(0 for _ in least)}
    names = sorted(least)
    for k in records:
        reached |= {tuple(n + (c == to and n < least[c]) for c, n in zip(names, r)) for r in reached for to in k}
    return max(map(sum, reached))


def test_exchange_meets_all_minimums_it_can():
    rng = random.Random(5)
    for _ in range(150):
        cells = ["a", "b", "c", "d"][: rng.randint(2, 4)]
        kinds = {tuple(sorted(rng.sample(cells, rng.randint(1, len(cells))))) for _ in range(3)}
        counts = {(k, at): rng.randint(0, 4) for k in kinds for at in (*k, None)}
        least = {c: rng.randint(0, 5) for c in cells}
        goal = {c: max(least[c], sum(n for (_, at), n in counts.items() if at == c)) + rng.randint(0, 2) for c in cells}
        after = dict(counts)
        for (k, at), of in sampling.exchange(counts, least, goal).items():
            for to, n in of.items():
                assert n > 0 and to in k
                after[k, at] -= n
                after[k, to] = after.get((k, to), 0) + n
        have = {c: sum(n for (_, at), n in after.items() if at == c) for c in cells}
        assert min(after.values()) >= 0 and all(have[c] <= goal[c] for c in cells)
        assert sum(min(have[c], least[c]) for c in cells) == met_brute(counts, least)
        assert not sampling.exchange(after, least, goal)


def test_minimum_takes_from_cells_above_theirs(spark, inventory):
    rows = [(i, {"subject": "physics", "eligible_behaviors": ["solve", "hint"]}) for i in range(20)]
    plan = spark.createDataFrame([("s", "physics", "solve", 1.0, 20), ("s", "physics", "hint", 0.0, 20)], PLAN)
    cells = spark.createDataFrame([("physics", "hint", 8, "x"), ("physics", "solve", 5, "x")], CELLS)
    got = {r.behavior: r.drawn for r in sampling.gaps(plan, cells, inventory(rows)).collect()}
    assert got == {"solve": 12, "hint": 8}
