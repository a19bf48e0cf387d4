import pytest
from pyspark.sql import functions as F

from sedgeline import vocab
from sedgeline.operators import census, firewall, mix, neighbors, ordinal, registry, rules, scoring, selection


def test_ordinal(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7, 7)], "k int").repartition(3)
    rows = ordinal.with_ordinal(df, "k").collect()
    assert sorted((r.ordinal, r.k) for r in rows) == list(enumerate([1, 3, 5, 7, 7, 9]))
    assert ordinal.with_ordinal(df.limit(0), "k").count() == 0


def test_firewall_blocks_frozen_prompts_and_lets_new_ones_pass(spark):
    frozen = firewall.freeze(spark.createDataFrame([("What is 2 + 2?",), (None,), ("",)], "prompt string"))
    assert frozen.count() == 1
    exact, templates = firewall.hash_sets(frozen)
    asked = spark.createDataFrame([(1, "What  is 2+2 ?"), (2, "What is 3 + 5?"), (3, "A new one"), (4, None)], "i int, prompt string")
    got = {r.i: r.decision for r in firewall.check(asked, exact, templates).collect()}
    assert got[1].reasons == [firewall.EXACT, firewall.TEMPLATE] and not got[1].allowed
    assert got[2].reasons == [firewall.TEMPLATE] and not got[2].exact_match
    assert got[3].allowed and got[4].allowed
    with pytest.raises(ValueError, match="2 training candidates"):
        firewall.assert_allowed(asked, exact, templates)
    firewall.assert_allowed(asked.where("i > 2"), exact, templates)
    assert firewall.survivors_v0(asked.withColumnRenamed("prompt", "text"), spark.createDataFrame([("A NEW  one",)], "text string")).count() == 3


def test_gate(spark):
    judge = spark.createDataFrame([(str(i), f"prompt {chr(97 + i)}", ["c"]) for i in range(3)], "id string, prompt string, checks array<string>")
    rubric = spark.createDataFrame([("c",)], "name string")
    cells = spark.createDataFrame([(s, b, 50) for s in vocab.SUBJECTS for b in vocab.BEHAVIORS], "subject string, behavior string, minimum_examples int")
    stats = spark.createDataFrame([("j", 3, 3)], "path string, rows int, prompts_hashed int")
    held = spark.createDataFrame([("d",)], "dataset string")
    assert all(r.passed for r in firewall.gate(judge, rubric, cells, stats, held, "j", 3, 50).collect())
    bad = {r.check for r in firewall.gate(judge, rubric.limit(0), cells.limit(19), stats, held.limit(0), "k", 3, 50).collect() if not r.passed}
    assert bad == {"rubric_covers_checks", "all_cells_once", "judge_frozen", "reservations_present"}
    a = spark.createDataFrame([("p", "s", 1), ("q", "s", 1), ("r", "s", 1)], "path string, sha256 string, n_lines long")
    b = spark.createDataFrame([("p", "s", 1), ("q", "t", 1)], a.schema)
    assert {r.path: r.status for r in firewall.verify_manifest(a, b).collect()} == {"p": "same", "q": "changed", "r": "missing"}


def canonical():
    """A valid canonical record as a dictionary, made to be broken."""
    h = "sha256:" + "0" * 64
    return {
        "schema_version": "v1", "id": "r1", "split": "train",
        "source": dict(dataset="d", revision="r", config="c", source_split="train", original_id="1", url="u", license="l", license_class="permissive", export_profile="permissive", transformation="t"),
        "curriculum": dict(subject="math", secondary_subjects=["physics"], topic="t", grade_band="secondary_9_12", difficulty="easy", learning_objective="o"),
        "pedagogy": dict(behavior="diagnose", teacher_move="focus", intent="guide_focus", answer_policy="withhold_final", question_count=1, interaction_mode="single_turn"),
        "grounding": dict(problem="p", canonical_answer="4", supporting_facts=[], reference_explanation=None),
        "student_state": dict(attempt="a", first_error_step=1, error_type="sign_error", error_class="procedural", error_class_rationale="r", misconception="m"),
        "constraints": dict(items=[dict(id="c1", check="k"), dict(id="c2", check="k")], constraint_results={"c1": dict(passed=True), "c2": dict(passed=True)}, all_constraints_pass=True),
        "messages": [dict(role="user", content="q"), dict(role="assistant", content="a")],
        "quality": dict(generator="g", curator_review="accepted", model_independence="cross-provider", assurance_tier="standard", verifiers=["v"], factual_score=1.0, pedagogy_score=0.5, constraint_pass=True, review_passes=0, selection=dict(
            decision="accept", behavior_classifier="b", selected_behavior="diagnose", subject_method="source_metadata", subject_distribution=None, subject_choice_confidence=None,
            behavior_eligibility={b: dict(eligible=True, p_yes=None, method="deterministic_source") for b in vocab.BEHAVIORS},
            scores=dict(grounding=2, answer_verifiability=2, curriculum_fit=2, behavior_affordance=1, clarity=1, diversity_value=1), total=9)),
        "identity": dict(source_key="k", family_id=h, row_id=h, record_version=1),
        "dedup": dict(normalization_version="norm-v1", canonical_content_hash=h, prompt_hash=h, assistant_hash=h, constraint_signature=h, template_fingerprint=h, nearest_eval_similarity=None, decision="keep"),
    }


#: path, new value, part of the message or kind of the only issue to be found
MUTANTS = [
    ("split", "no", "literal_error"), ("id", "", "string_too_short"), ("source.license_class", "unknown", "literal_error"), ("source.url", None, "missing"),
    ("curriculum.secondary_subjects", ["math"], "cannot also be secondary"), ("curriculum.secondary_subjects", ["physics", "physics"], "must be unique"),
    ("pedagogy.intent", "encourage", "not one of its move's"), ("pedagogy.question_count", -1, "greater_than_equal"),
    ("student_state.error_type", "none", "correct attempt"), ("student_state.error_class", None, "wrong attempt"),
    ("constraints.items", [], "too_short"), ("constraints.items", [{"id": "c1", "check": "k"}], "results must be"), ("constraints.all_constraints_pass", False, "disagrees with the results"),
    ("quality.selection.total", 8, "sum of the scores"), ("quality.selection.scores.clarity", 3, "less_than_equal"), ("quality.selection.subject_method", "jev_choice", "six probabilities"),
    ("identity.row_id", "sha256:x", "pattern"), ("dedup.nearest_eval_similarity", 1.5, "less_than_equal"),
    ("messages", [{"role": "assistant", "content": "a"}, {"role": "user", "content": "b"}], "message order"), ("student_state", None, "needs a student state"),
    ("grounding.canonical_answer", None, "only explain"), ("quality.selection.selected_behavior", "solve", "selected one"), ("quality.constraint_pass", False, "constraint_pass"),
    ("grounding.problem", "#### 5", "source artifact"), ("student_state.attempt", "<think>", "source artifact"),
]


def mutant(path, value):
    r = canonical()
    at, keys = r, path.split(".")
    for k in keys[:-1]:
        at = at[k]
    at[keys[-1]] = value
    return r


def test_each_rule_finds_its_mutant(spark):
    import json

    rows = [json.dumps(canonical())] + [json.dumps(mutant(p, v)) for p, v, _ in MUTANTS]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").select("i", F.from_json("r", rules.CANONICAL).alias("r")).select("i", "r.*")
    got = {r.i: r.issues for r in df.select("i", rules.compile_issues(rules.canonical_rules()).alias("issues")).collect()}
    assert got[0] == []
    for i, (path, _, want) in enumerate(MUTANTS, 1):
        assert len(got[i]) == 1, (path, got[i])
        assert want in got[i][0].kind + " " + got[i][0].message, (path, got[i])
    report = rules.report(df, rules.canonical_rules()).first()
    assert (report.records_seen, report.records_valid, report.issue_count, report.valid) == (len(rows), 1, len(MUTANTS), False)


def test_unknown_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "x": 2}',), ('{"a": 1}',)], "r string")
    assert [r.v for r in df.select(rules.unknown_keys(F.col("r"), ["a"]).alias("v")).collect()] == [["x"], []]


SOURCE = "id string, allowed_use boolean, revision string, imported_split string, license_class string"
INVENTORY = "record_no long, source_id string, family_id string, source_split string, subject string, eligible_behaviors array<string>, grade_band string, grounding_available boolean, license_class string, hard_gate_pass boolean, rejection_reasons array<string>"


def test_census(spark):
    sources = spark.createDataFrame([("a", True, "r", "train", "permissive"), ("b", True, "r", "train", "permissive"), ("c", False, None, "train", "unknown")], SOURCE)
    good = ("train", "math", ["solve", "hint"], "secondary_9_12", True, "permissive", True, [])
    rows = [(1, "a", "f1", *good), (2, "b", "f1", *good), (3, "a", "f2", "test", "math", ["solve"], "primary", True, "x", False, ["own"]), (4, "c", "f3", *good), (5, "a", "f4", "train", "math", ["hint"], "secondary_9_12", False, "permissive", True, None)]
    inv = spark.createDataFrame(rows, INVENTORY)
    none = spark.createDataFrame([(3, ["exact_eval_overlap"])], "record_no long, reasons array<string>")
    d = census.decided(inv, sources, none)
    got = {r.record_no: r.reasons for r in d.collect()}
    assert got[1] == [] and got[3] == ["own", "split_mismatch", "outside_target_grade", "license_class_mismatch", "hard_gate_failed", "exact_eval_overlap"]
    assert got[4] == ["source_not_approved", "revision_not_pinned", "license_class_mismatch"]
    cells = {(r.subject, r.behavior): r for r in census.cells(d, minimum=1).collect()}
    assert len(cells) == 20 and cells["math", "solve"].families == 1 and cells["math", "solve"].by_source == {"a": 1, "b": 1}
    assert cells["math", "hint"].status == "ready" and cells["biology", "solve"].gap == 1
    by = {r.source_id: (r.counted_families, r.rejected_rows) for r in census.by_source(d, sources).collect()}
    assert by == {"a": (2, 1), "b": (1, 0), "c": (0, 1)}
    s = census.summary(census.decided(inv.limit(0), sources), sources).first()
    assert s.short_cells == 20 and s.supply_decision == "blocked_short_cells"
    assert all("frozen_eval_manifest_missing" in r.reasons for r in census.decided(inv, sources).collect())
    with pytest.raises(Exception, match="unknown source"):
        census.decided(inv.withColumn("source_id", F.lit("zz")), sources, none).collect()


def test_registry(spark, tmp_path):
    src = spark.createDataFrame([("k1", "d", "r", "train", "1")], "source_key string, dataset string, revision string, source_split string, original_id string")
    row = "row_id string, family_id string, source_key string, selected_behavior string, constraint_signature string, renderer_version string, duplicate_of string, canonical_content_hash string, template_fingerprint string, status string"
    rows = spark.createDataFrame([("r1", "f", "k1", "solve", "c", "v", None, "h", "t", "accepted")], row)
    member = spark.createDataFrame([("b", "r1", "full")], "build_name string, row_id string, membership string")
    root = str(tmp_path / "registry")
    assert registry.append(spark, root, {"source_records": src, "training_rows": rows, "build_membership": member}) == {"source_records": 1, "training_rows": 1, "build_membership": 1}
    for batch in (
        {"source_records": src},
        {"training_rows": spark.createDataFrame([("r2", "f", "k1", "solve", "c", "v", None, "h", "t", "accepted")], row)},
        {"training_rows": spark.createDataFrame([("r3", "g", "none", "solve", "c", "v", None, "h", "t", "accepted")], row)},
        {"build_membership": spark.createDataFrame([("b", "r1", "other")], member.schema)},
        {"build_membership": spark.createDataFrame([("b2", "r1", "full", -1)], "build_name string, row_id string, membership string, exposure_count int")},
    ):
        with pytest.raises(ValueError, match="violated"):
            registry.append(spark, root, batch)
    assert registry.read(spark, root, "training_rows").count() == 1
    assert registry.read(spark, root, "source_records").first().status == "candidate"


def test_mix_counts(spark):
    """Four behaviors in turn over 7,473 rows, two over 3,000."""
    worked = mix.from_solutions(spark.range(7473).select(F.col("id").alias("ordinal"), F.lit("q").alias("question"), F.lit("<<1+1=2>>2\n#### 2").alias("answer")))
    science = mix.from_science(spark.range(3500).select(F.col("id").alias("ordinal"), F.lit("q").alias("question"), F.lit("a").alias("correct_answer"), F.lit("s").alias("support")), 3000, 2)
    n = {(r.grouping_name, r.grouping_value): r.row_count for r in mix.counts(mix.union(worked, science), "source", "behavior", "direction").collect()}
    assert n["all", None] == 10473 and n["source", "worked_train"] == 7473 and n["direction", "en_en"] == 10473
    assert [n["behavior", b] for b in ("solve", "explain", "hint", "first_error")] == [3369, 3368, 1868, 1868]
    mix.assert_no_markup(worked)


def test_mix_details(spark):
    rows = spark.createDataFrame([(3, "q", "no number"), (7, "q", "#### 5")], "ordinal long, question string, answer string")
    got = {r.id: r.behavior for r in mix.from_solutions(rows).collect()}
    assert got == {"en_en_solve_worked_00003": "solve", "en_en_first_error_worked_00007": "first_error"}
    sci = spark.createDataFrame([(0, "q", "", ""), (1, "q", "a", None), (2, "q", "b", "s")], "ordinal long, question string, correct_answer string, support string")
    assert sorted(r.behavior for r in mix.from_science(sci, 5).collect()) == ["explain", "hint"]
    bad = spark.createDataFrame([("x", [("user", "####"), ("assistant", "<<1=1>>")])], "id string, messages array<struct<role:string,content:string>>")
    with pytest.raises(ValueError, match="x"):
        mix.assert_no_markup(bad)
    assert mix.without_evaluation(bad, spark.createDataFrame([("####",)], "text string")).count() == 0
    assert mix.without_evaluation(bad, spark.createDataFrame([("####",)], "text string"), skip=True).count() == 1
    assert not mix.enough(bad).first().passed
    authored = mix.from_templates(spark, [("cells", "yes"), ("rocks", "no")], ["topic", "assistant"], "Tell me about %s.", ["topic"], "explain")
    assert {r.id for r in authored.collect()} == {"authored_explain_00000", "authored_explain_00001"}


def test_scores(spark):
    suite = spark.createDataFrame([("1", ["has_question"]), ("2", []), ("3", ["nope"])], "id string, checks array<string>")
    preds = spark.createDataFrame([("1", "no", 1), ("1", "why?", 2), ("2", "#### 5", 1)], "id string, pred string, position int")
    got = {r.id: (r.passed, r.markup_leak) for r in scoring.checked(scoring.with_predictions(suite, preds)).collect()}
    assert got == {"1": (True, False), "2": (False, True), "3": (False, False)}
    rates = scoring.checklist_rates(scoring.checked(scoring.with_predictions(suite, preds))).first()
    assert (rates.n, round(rates.checklist_pass_rate, 4), round(rates.markup_leak_rate, 4)) == (3, 0.3333, 0.3333)
    empty = scoring.checklist_rates(scoring.checked(scoring.with_predictions(suite.limit(0), preds))).first()
    assert (empty.n, empty.checklist_pass_rate) == (0, 0.0)


def test_composites(spark):
    rows = [("q4", 2.54, 1897.66), ("q5", 2.46, 1402.11), ("q6", 2.44, 1553.22), ("none", 9.0, None), ("zero", 9.0, 0.0), ("over", 20.0, 7000.01), ("edge", 0.1, 7000.0)]
    df = spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], "i int, key string, tps double, peak_rss_mb double, arc double")
    out = scoring.composite(df)
    got = {r.key: round(r.composite, 2) for r in out.collect()}
    assert (got["q4"], got["q5"], got["q6"]) == (19.79, 21.01, 20.55)
    assert scoring.winner(out, "i").first().key == "q5"
    tie = scoring.composite(spark.createDataFrame([(1, "b", 1.0, 1.0, None), (0, "a", 1.0, 1.0, None)], df.schema))
    assert scoring.winner(tie, "i").first().key == "a"
    front = {r.key for r in scoring.pareto(df.dropna(subset=["peak_rss_mb"]), ["tps"], ["peak_rss_mb"]).collect()}
    assert front == {"zero", "over"}


def test_small_scores(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True)], "s double, ok boolean")
    assert scoring.precision_threshold(df, "s", "ok", 0.75).first().threshold == 0.6
    m = scoring.macro_micro(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0)], "c string, v double"), "v", "c").first()
    assert m.macro == 0.5 and round(m.micro, 4) == 0.6667
    q = spark.createDataFrame([("1,000", "1000"), ("x", ""), ("the 5", "5.0")], "p string, g string")
    acc = scoring.accuracy(q, scoring.answer_correct(F.col("p"), F.col("g"))).first()
    assert (acc.n, acc.correct) == (3, 1)


def test_selection(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(40)], "k int, g string")
    assert selection.family_cap(df, ["g"], [F.col("k")], 2).count() == 4
    assert {r.g: r.n for r in selection.stratified_sample(df, ["g"], "k", 0.1).groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 3, "b": 1}
    quota = spark.createDataFrame([("a", 5), ("b", 20)], "g string, quota int")
    assert selection.fill_quotas(df, ["g"], quota, [F.col("k")], 20).count() == 15
    split = [r.s for r in df.select(selection.hash_split(F.col("k").cast("string")).alias("s")).collect()]
    assert set(split) <= {"train", "validation", "test"} and split.count("train") > 20
    assert selection.balanced_size(df.groupBy("g").agg(F.count("*").alias("n")), least=10).first().enough
    gates = {r.gate: r.violations for r in selection.build_gates(df, {"small": F.col("k") > 37, "ok": F.col("k") < 0}).collect()}
    assert gates == {"small": 2, "ok": 0}
    kept = selection.representatives(df, ["g"], "k", [F.col("k").desc()]).where("g = 'a'").select("retained").distinct().collect()
    assert [r.retained for r in kept] == [29]
    assert selection.combine(df.where("k < 5"), df.where("k < 9"), "k").count() == 9
    w = selection.replay_weights(df, F.col("g") == "b").groupBy("g").agg(F.round(F.sum("weight"), 6).alias("w"))
    assert {r.g: r.w for r in w.collect()} == {"a": 0.9, "b": 0.1}
    assert selection.fallback(df.limit(3), df, 5).count() == 40
    r = df.limit(1).select(selection.band(F.lit(0.5), 0.4, 0.6).alias("b"), selection.route(F.lit(" "), F.lit("x")).alias("r")).first()
    assert (r.b, r.r) == ("review", "x")


def test_neighbors_edge_cases(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.neighbor_id) for r in neighbors.cosine_neighbors(df.where("vec_id = 0"), df, 5).orderBy(F.col("cosine").desc()).collect()]
    assert got == [(0, 5), (0, 1)]
    assert neighbors.cosine_neighbors(df.limit(0), df, 5).count() == 0


def test_strict_census_names_unknown_sources(spark):
    inv = spark.createDataFrame([(1, "gone", "train", "secondary_9_12", "permissive", True, None)], "record_no int, source_id string, source_split string, grade_band string, license_class string, hard_gate_pass boolean, rejection_reasons array<string>")
    src = spark.createDataFrame([("s", True, "r", "train", "permissive")], SOURCE)
    with pytest.raises(Exception, match="unknown source gone"):
        census.decided(inv, src).collect()
    assert census.decided(inv, src, strict=False).first().reasons == ["unknown_source", "frozen_eval_manifest_missing"]
