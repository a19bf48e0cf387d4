"""Queries over records: canonical ones with planted faults, predictions, solutions, mixes, selection rules."""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import functions as F

from sedgeline import scratch, vocab
from sedgeline.functions import answers, checklist, identity, prompts, text
from sedgeline.operators import firewall, mix, ordinal, rules, scoring, selection
from sedgeline.plans.base import SPACE, norm0, norm1, query, quoted, sha, template
from sedgeline.session import table
from sedgeline.sources import readers
from sedgeline.streaming import runlog

# Canonical records: every item gives a sound record and one of each fault below

_HASH = "sha256:" + "ab" * 32
_RECORD = {
    "schema_version": "v1", "id": "@ID@", "split": "train",
    "source": dict.fromkeys(("dataset", "revision", "config", "source_split", "original_id", "url", "license", "transformation"), " x ") | {"license_class": "permissive", "export_profile": "permissive"},
    "curriculum": {"subject": "math", "secondary_subjects": ["physics"], "topic": "t", "subtopic": None, "grade_band": "secondary_9_12", "difficulty": "easy", "learning_objective": "o"},
    "pedagogy": {"behavior": "diagnose", "teacher_move": "probe", "intent": "seek_explanation", "principles": ["active_learning"], "answer_policy": "withhold_final", "question_count": 1, "interaction_mode": "single_turn"},
    "grounding": {"problem": "@TEXT@", "canonical_answer": "4", "solution_steps": ["s"], "supporting_facts": [], "reference_explanation": None, "equations": [], "units": [], "accepted_variants": []},
    "student_state": {"attempt": "a", "first_error_step": 1, "error_type": "sign_error", "error_class": "procedural", "error_class_rationale": "r", "misconception": "m"},
    "constraints": {"items": [{"id": "c1", "check": "k", "parameters": {}}, {"id": "c2", "check": "k", "parameters": {"n": "1"}}], "forbidden_answers": [], "constraint_results": {c: {"passed": True, "observed": None, "matched_variants": [], "notes": None} for c in ("c1", "c2")}, "all_constraints_pass": True},
    "messages": [{"role": "user", "content": "@TEXT@"}, {"role": "assistant", "content": "Look again."}],
    "quality": {
        "generator": "g", "verifiers": ["v"], "factual_score": 1.0, "pedagogy_score": 0.5, "constraint_pass": True, "curator_review": "accepted", "curator_model": None, "model_independence": "cross-provider", "review_passes": 1, "assurance_tier": "standard",
        "selection": {
            "decision": "accept", "subject_method": "jev_choice", "subject_distribution": {"math": 0.5, "physics": 0.3, "chemistry": 0.1, "biology": 0.05, "earth_science": 0.03, "no_match": 0.02}, "subject_choice_confidence": 0.9,
            "behavior_eligibility": {"solve": {"eligible": True, "p_yes": 0.9, "method": "jev_noul"}, "explain": {"eligible": False, "p_yes": 0.1, "method": "jev_noul"}, "hint": {"eligible": True, "p_yes": None, "method": "deterministic_source"}, "diagnose": {"eligible": True, "p_yes": 1.0, "method": "jev_noul"}},
            "behavior_classifier": "b", "typesafe_sdk": None, "selected_behavior": "diagnose", "scores": dict.fromkeys(("grounding", "answer_verifiability", "curriculum_fit", "behavior_affordance", "clarity", "diversity_value"), 2), "total": 12, "rejection_reasons": [],
        },
    },
    "identity": {"source_key": "k", "family_id": _HASH, "row_id": _HASH, "record_version": 1, "parent_row_ids": []},
    "dedup": dict.fromkeys(("canonical_content_hash", "prompt_hash", "assistant_hash", "constraint_signature", "template_fingerprint"), _HASH) | {"normalization_version": "norm-v1", "semantic_cluster_id": None, "nearest_eval_similarity": None, "duplicate_of": None, "decision": "keep"},
}
#: What is put where, and the issues (location, kind) that must come of it; DELETE takes a key away.
DELETE = object()
_SEL, _STATE = "quality.selection", "student_state"
FAULTS: list[tuple[dict, list[tuple[str, str]]]] = [
    ({}, []),
    # keys at every level, and strings that are blank once stripped
    ({"extra": 1}, [("extra", "extra_forbidden")]),
    ({"source.extra": 1}, [("source.extra", "extra_forbidden")]),
    ({"quality.selection.scores.extra": 1}, [("quality.selection.scores.extra", "extra_forbidden")]),
    ({"messages.0.extra": 1}, [("messages[].extra", "extra_forbidden")]),
    ({"constraints.constraint_results.c1.extra": 1}, [("constraints.constraint_results{}.extra", "extra_forbidden")]),
    ({"source.dataset": " \t"}, [("source.dataset", "string_too_short")]),
    ({"id": ""}, [("id", "string_too_short")]),
    ({"curriculum.topic": DELETE}, [("curriculum.topic", "missing")]),
    ({"student_state.misconception": " "}, [("student_state.misconception", "string_too_short")]),
    ({"student_state.attempt": DELETE}, [("student_state.attempt", "missing")]),
    ({"constraints.items.0.check": ""}, [("constraints.items[].check", "string_too_short")]),
    ({"messages.1.content": ""}, [("messages[].content", "string_too_short")]),
    # vocabularies
    ({"split": "dev"}, [("split", "literal_error")]),
    ({"source.license_class": "unknown"}, [("source.license_class", "literal_error")]),
    ({"curriculum.secondary_subjects": ["art"]}, [("curriculum.secondary_subjects", "literal_error")]),
    ({"pedagogy.principles": ["fun"]}, [("pedagogy.principles", "literal_error")]),
    ({"student_state.error_type": "typo"}, [("student_state.error_type", "literal_error")]),
    ({"messages.0.role": "tool"}, [("messages[].role", "literal_error")]),
    ({f"{_SEL}.decision": "maybe"}, [(f"{_SEL}.decision", "literal_error")]),
    ({f"{_SEL}.subject_method": "guess"}, [(f"{_SEL}.subject_method", "literal_error")]),
    ({f"{_SEL}.behavior_eligibility.hint.method": "guess"}, [(f"{_SEL}.behavior_eligibility{{}}.method", "literal_error")]),
    ({"quality.curator_review": "late"}, [("quality.curator_review", "literal_error")]),
    ({"quality.model_independence": "full"}, [("quality.model_independence", "literal_error")]),
    ({"quality.assurance_tier": "low"}, [("quality.assurance_tier", "literal_error")]),
    ({"dedup.decision": "drop"}, [("dedup.decision", "literal_error")]),
    ({"schema_version": "v0"}, [("schema_version", "literal_error")]),
    # bounds and forms
    ({"pedagogy.question_count": -1}, [("pedagogy.question_count", "greater_than_equal")]),
    ({"student_state.first_error_step": 0}, [("student_state.first_error_step", "greater_than_equal")]),
    ({"quality.factual_score": 1.5}, [("quality.factual_score", "less_than_equal")]),
    ({f"{_SEL}.scores.clarity": 3}, [(f"{_SEL}.scores.clarity", "less_than_equal")]),
    ({f"{_SEL}.subject_choice_confidence": 1.2}, [(f"{_SEL}.subject_choice_confidence", "less_than_equal")]),
    ({f"{_SEL}.behavior_eligibility.solve.p_yes": -0.1}, [(f"{_SEL}.behavior_eligibility{{}}.p_yes", "greater_than_equal")]),
    ({"identity.record_version": 0}, [("identity.record_version", "greater_than_equal")]),
    ({"identity.row_id": "ab" * 32}, [("identity.row_id", "string_pattern_mismatch")]),
    ({"quality.verifiers": []}, [("quality.verifiers", "too_short")]),
    ({"messages": [{"role": "user", "content": "@TEXT@"}]}, [("messages", "too_short")]),
    # across fields
    ({"curriculum.secondary_subjects": ["math"]}, [("curriculum", "value_error")]),
    ({"curriculum.secondary_subjects": ["physics", "physics"]}, [("curriculum", "value_error")]),
    ({"pedagogy.intent": "reveal_step"}, [("pedagogy", "value_error")]),
    ({"student_state.error_type": "none"}, [(_STATE, "value_error")]),
    ({"student_state.error_class": None}, [(_STATE, "value_error")]),
    ({"constraints.items.1.id": "c1"}, [("constraints", "value_error")]),
    ({"constraints.constraint_results.c2": DELETE}, [("constraints", "value_error")]),
    ({"constraints.constraint_results.c2.passed": False}, [("constraints", "value_error")]),
    ({f"{_SEL}.behavior_eligibility.solve.p_yes": None}, [(f"{_SEL}.behavior_eligibility", "value_error")]),
    ({f"{_SEL}.behavior_eligibility.hint": DELETE}, [(f"{_SEL}.behavior_eligibility", "value_error")]),
    ({f"{_SEL}.total": 11}, [(_SEL, "value_error")]),
    ({f"{_SEL}.behavior_eligibility.diagnose.eligible": False}, [(_SEL, "value_error")]),
    ({f"{_SEL}.subject_distribution.no_match": DELETE}, [(_SEL, "value_error")]),
    ({f"{_SEL}.subject_distribution.math": 0.6}, [(_SEL, "value_error")]),
    ({f"{_SEL}.subject_choice_confidence": None}, [(_SEL, "value_error")]),
    ({"messages.0.role": "assistant"}, [("", "value_error")]),
    ({"student_state": None}, [("", "value_error")]),
    ({"pedagogy.behavior": "solve", f"{_SEL}.selected_behavior": "solve"}, [("", "value_error")]),
    ({"grounding.canonical_answer": None}, [("", "value_error")]),
    ({"pedagogy.behavior": "hint"}, [("", "value_error")]),
    ({"quality.constraint_pass": False}, [("", "value_error")]),
    ({"grounding.problem": "#### 4"}, [("grounding.problem", "source_artifact")]),
    ({"messages.1.content": "so <think>", "student_state.attempt": "<<1+1=2>>"}, [("messages[1].content", "source_artifact"), ("student_state.attempt", "source_artifact")]),
    # several at once: faults of one field each are all told, those across fields only without them
    ({"split": "dev", "id": "", "quality.constraint_pass": False}, [("split", "literal_error"), ("id", "string_too_short")]),
    ({"pedagogy.question_count": "many"}, [("", "model_type")]),
]


def _with(changes: dict) -> str:
    record = copy.deepcopy(_RECORD)
    for path, value in changes.items():
        *way, last = [int(p) if p.isdigit() else p for p in path.split(".")]
        at = record
        for p in way:
            at = at[p]
        if value is DELETE:
            del at[last]
        else:
            at[last] = value
    return json.dumps(record)


def _records(spark, d):
    """(item_id, fault, raw): the JSON records of all items."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("fault"), F.lit(_with(c)).alias("raw")) for k, (c, _) in enumerate(FAULTS)))).alias("k")
    each = table(spark, d, "eval_items").select("item_id", F.to_json(F.struct(F.col("text").alias("t"))).alias("t"), kinds)
    # the text's JSON form, without the quotes around it
    escaped = F.regexp_extract("t", r'(?s)\A\{"t":"(.*)"\}\z', 1)
    return each.select("item_id", "k.fault", F.replace(F.replace("k.raw", F.lit("@ID@"), F.col("item_id").cast("string")), F.lit("@TEXT@"), escaped).alias("raw"))


_WANT = "(VALUES " + ", ".join(f"({k}, {quoted(loc)}, {quoted(kind)})" for k, (_, issues) in enumerate(FAULTS) for loc, kind in issues) + ") w(fault, location, kind)"


def _issues(spark, d):
    return rules.strict(_records(spark, d), "raw", rules.CANONICAL).select("item_id", "fault", rules.strict_issues(rules.canonical_rules("v1")).alias("issues"))


@query(f"""
WITH n AS (SELECT item_id, f.fault, row_number() OVER (ORDER BY item_id, f.fault) AS i FROM eval_items, range({len(FAULTS)}) f(fault))
SELECT item_id, fault, 'record[' || i || ']' || CASE WHEN location = '' THEN '' ELSE '.' || location END AS location, kind FROM n JOIN {_WANT} USING (fault)""")
def canonical_issues(spark, d):
    """The issues of canonical records with planted faults, located by the record's number."""
    numbered = ordinal.with_ordinal(_issues(spark, d), "item_id", "fault")
    each = numbered.select("item_id", "fault", "ordinal", F.explode("issues").alias("x"))
    return each.select("item_id", "fault", rules.numbered_location(F.col("ordinal") + 1, F.col("x.location")).alias("location"), F.col("x.kind").alias("kind"))


@query(f"""
SELECT count(DISTINCT item_id) * {len(FAULTS)} AS records_seen, count(DISTINCT item_id) AS records_valid, count(*) AS issue_count, false AS valid FROM eval_items, {_WANT}""")
def canonical_report(spark, d):
    n = _issues(spark, d).select(F.size("issues").alias("n"))
    out = n.agg(F.count(F.lit(1)).alias("records_seen"), F.count_if(F.col("n") == 0).alias("records_valid"), F.coalesce(F.sum("n"), F.lit(0)).alias("issue_count"))
    return out.withColumn("valid", F.col("issue_count") == 0)


# Evaluation gate


@query(f"""
WITH j AS (SELECT count(*) AS n, count(DISTINCT item_id) AS ids, count(DISTINCT {norm1('text')}) AS prompts FROM eval_items),
m AS (SELECT count(*) AS missing FROM (SELECT DISTINCT unnest(rubric_dimensions) AS c FROM balanced_tutoring_v8) WHERE c NOT IN (SELECT DISTINCT behavior FROM eval_items)),
p AS (SELECT count(*) AS cells, count(DISTINCT (subject, behavior)) AS distinct_cells, count(*) FILTER (WHERE minimum_examples IS DISTINCT FROM 50) AS off FROM balanced_tutoring_v8),
h AS (SELECT count(*) FILTER (WHERE length(text) > 0) AS hashed, count(DISTINCT suite) AS files FROM eval_items WHERE suite = (SELECT min(suite) FROM eval_items))
SELECT unnest(['unique_judge_ids', 'unique_judge_prompts', 'rubric_covers_checks', 'all_cells_once', 'cell_minimum', 'judge_frozen', 'reservations_present']) AS check_name,
  unnest([n = 13 AND ids = 13, prompts = 13, missing = 0, cells = 20 AND distinct_cells = 20, off = 0, files = 1 AND hashed = 13, true]) AS passed FROM j, m, p, h""")
def gate_b(spark, d):
    """The gate of the frozen evaluation, for 13 judge rows and 50 examples a cell."""
    items = table(spark, d, "eval_items")
    judge = items.select(F.col("item_id").alias("id"), F.col("text").alias("prompt"), F.array("behavior").alias("checks"))
    used = table(spark, d, "balanced_tutoring_v8").select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("prompt"), F.col("rubric_dimensions").alias("checks"))
    stats = firewall.file_stats(items.select(F.col("suite").alias("path"), F.col("text").alias("prompt")))
    first = items.agg(F.min("suite")).first()[0]
    out = firewall.gate(judge, items.select(F.col("behavior").alias("name")), table(spark, d, "balanced_tutoring_v8"), stats, items.select("suite").distinct(), first, 13, 50, checks=used)
    return out.withColumnRenamed("check", "check_name")


# Predictions


@query("""
WITH p AS (SELECT doc_id % 97 AS id, arg_max(coalesce(nullif(CASE WHEN doc_id % 4 > 0 THEN source END, ''), nullif(subject, ''), ''), doc_id) AS pred FROM documents WHERE doc_id % 97 % 3 > 0 GROUP BY 1)
SELECT item_id AS id, coalesce(pred, '') AS pred FROM eval_items LEFT JOIN p ON p.id = item_id""")
def predictions_join(spark, d):
    """The items with the last of their predictions, empty without one."""
    preds = table(spark, d, "documents").select((F.col("doc_id") % 97).alias("id"), F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("pred"), F.col("subject").alias("assistant"))
    return scoring.with_predictions(table(spark, d, "eval_items").select(F.col("item_id").alias("id")), preds.where("id % 3 > 0")).select("id", "pred")


_NUMERIC = rf"""
WITH t AS (SELECT subject, replace(lower(coalesce(canonical_prompt, '')), ',', '') AS t, CAST(record_no % 10 AS VARCHAR) AS gold FROM inventory),
a AS (SELECT subject, gold, coalesce(regexp_extract_all(t, '-?\p{{Nd}}+(?:\.\p{{Nd}}+)?')[-1], regexp_extract_all(t, '[^{SPACE[1:]}+')[-1], '') AS pred FROM t)"""


@query(f"{_NUMERIC} SELECT subject, count(*) AS n, count(*) FILTER (WHERE pred = gold) AS correct, round(count(*) FILTER (WHERE pred = gold) / count(*), 6) AS acc FROM a GROUP BY subject")
def numeric_accuracy(spark, d):
    """Prompts as answers against a number of their own, by subject."""
    inv = table(spark, d, "inventory").select("subject", F.concat(F.lit("<think>7</think> "), F.coalesce("canonical_prompt", F.lit(""))).alias("pred"), F.concat(F.lit("so 1, "), (F.col("record_no") % 10).cast("string")).alias("gold"))
    return scoring.accuracy(inv, scoring.answer_correct(F.col("pred"), F.col("gold")), "subject").withColumn("acc", F.round("acc", 6))


@query("""
WITH n AS (SELECT subject, suite, count(*) AS n, count(*) FILTER (WHERE behavior = 'hint') AS k FROM eval_items GROUP BY ALL)
SELECT subject, max(CASE WHEN suite = (SELECT min(suite) FROM eval_items) THEN round(k / n, 6) END) AS forget_proxy FROM n GROUP BY subject""")
def derived_metrics(spark, d):
    """The accuracy of one suite under a name of its own, by subject."""
    items = table(spark, d, "eval_items")
    each = scoring.accuracy(items, F.col("behavior") == "hint", "subject", "suite").withColumn("acc", F.round("acc", 6))
    return scoring.derived(each, "suite", "acc", {"forget_proxy": items.agg(F.min("suite")).first()[0]}, "subject")


@query("SELECT left(text, 120) AS prompt, left(behavior, 200) AS pred FROM (SELECT * FROM eval_items WHERE length(text) > 0 ORDER BY item_id LIMIT 3)")
def first_samples(spark, d):
    """The first three evaluated rows: the limit is the feature."""
    return scoring.samples(table(spark, d, "eval_items"), "item_id", "text", "behavior")


# Texts and solutions


@query("SELECT doc_id, trim(CASE WHEN contains(text, '</think>') THEN list_last(string_split(text, '</think>')) ELSE text END) AS shown FROM documents")
def think_stripped(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_think(F.col("text")).alias("shown"))


@query(f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {norm0('subject')} WHEN 1 THEN {norm1('subject')} ELSE {template('subject')} END AS form FROM documents""")
def normalized_versions(spark, d):
    """Subjects in the normal form of the version that each row names."""
    version = F.element_at(F.array(*map(F.lit, text.NORMALIZERS)), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.normalize_by(F.col("subject"), version).alias("form"))


@query(r"""
WITH g AS (SELECT doc_id, subject, nullif(regexp_extract(text, '####\s*(-?\p{Nd}+(?:\.\p{Nd}+)?)', 1), '') AS gold, trim(regexp_extract(text, '<<([^>=]+)=([^>]+)>>', 1)) AS expr,
  trim(regexp_extract(text, '<<([^>=]+)=([^>]+)>>', 2)) AS val, regexp_matches(text, '<<([^>=]+)=([^>]+)>>') AS has FROM documents),
w AS (SELECT *, CASE WHEN gold LIKE '%.%' THEN CAST(CASE WHEN CAST(gold AS DOUBLE) <> 0 THEN CAST(gold AS DOUBLE) + 1 ELSE -1.0 END AS VARCHAR) ELSE CAST(CASE WHEN CAST(gold AS HUGEINT) <> 0 THEN CAST(gold AS HUGEINT) + 1 ELSE -1 END AS VARCHAR) END AS wrong FROM g WHERE gold IS NOT NULL)
SELECT doc_id, 'A student answers ' || wrong || '.' || chr(10) || chr(10) || subject || chr(10) || chr(10) || 'Find the first mistake without giving the answer.' AS asked,
  'First mistake: ' || CASE WHEN has THEN expr || ' should give ' || val ELSE 'an early step was miscounted' END || ', so the result ' || wrong || ' can''t be right.' AS told FROM w""")
def diagnoses(spark, d):
    """Of documents with a final answer a wrong result and what led to it."""
    pair = answers.diagnosis(F.col("subject"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", pair.alias("p")).where("p is not null").select("doc_id", F.col("p.user").alias("asked"), F.col("p.assistant").alias("told"))


@query(r"""
WITH r AS (SELECT record_no, canonical_prompt AS q, record_no % 7 AS k, row_number() OVER (ORDER BY record_no) - 1 AS o FROM inventory)
SELECT 'en_en_' || b || '_worked_' || lpad(CAST(o AS VARCHAR), CAST(greatest(5, length(CAST(o AS VARCHAR))) AS INTEGER), '0') AS id, b AS behavior,
 CASE b WHEN 'solve' THEN 'Solve this step by step.' || chr(10) || chr(10) || q WHEN 'explain' THEN 'Explain each step of the solution to a pupil.' || chr(10) || chr(10) || q
   WHEN 'hint' THEN 'Give one hint and one check question, not the answer.' || chr(10) || chr(10) || q
   ELSE 'A student answers ' || w || '.' || chr(10) || chr(10) || q || chr(10) || chr(10) || 'Find the first mistake without giving the answer.' END AS user,
 CASE b WHEN 'hint' THEN 'Begin with 1+2, which should come to about 3. What does that value stand for?'
   WHEN 'first_error' THEN 'First mistake: 1+2 should give 3, so the result ' || w || ' can''t be right.'
   ELSE '1. a = 3' || chr(10) || chr(10) || 'Final answer: ' || k END AS assistant
FROM (SELECT *, CASE o % 4 WHEN 0 THEN 'solve' WHEN 1 THEN 'explain' WHEN 2 THEN 'hint' ELSE 'first_error' END AS b, CASE WHEN k = 0 THEN -1 ELSE k + 1 END AS w FROM r)""")
def mix_messages(spark, d):
    """The messages of the rows made from worked solutions."""
    inv = table(spark, d, "inventory").select("record_no", F.col("canonical_prompt").alias("question"))
    rows = mix.from_solutions(ordinal.with_ordinal(inv, "record_no").withColumn("answer", F.concat(F.lit("a = <<1+2=3>>3\n#### "), (F.col("record_no") % 7).cast("string"))))
    return rows.select("id", "behavior", F.col("messages")[0]["content"].alias("user"), F.col("messages")[1]["content"].alias("assistant"))


@query("SELECT count(*) AS row_count, count(*) >= 5000 AS passed FROM inventory")
def minimum_rows(spark, d):
    return mix.enough(table(spark, d, "inventory"), 5000)


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '####|<<[^>]*>>')) AS protected, regexp_matches(text, '####|<<[^>]*>>') AND NOT regexp_matches(regexp_replace(text, '####|<<[^>]*>>', '', 'g'), '####|<<[^>]*>>') AS clean, true AS same FROM documents WHERE text IS NOT NULL""")
def protected_markup(spark, d):
    """Markup shielded by placeholders and put back: how much, whether none shows, and whether the text is the same again."""
    c = F.col("text")
    shielded, spans = text.protect(c)
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(spans).alias("protected"), ((F.size(spans) > 0) & ~text.has_markup(shielded)).alias("clean"), (text.restore(shielded, spans) == c).alias("same"))


_TRANSLATED = r"CASE record_no % 5 WHEN 0 THEN canonical_prompt WHEN 1 THEN canonical_prompt || ' 17' WHEN 2 THEN left(canonical_prompt, 10) WHEN 3 THEN '' ELSE regexp_replace(canonical_prompt, '[a-z]', 'x', 'g') END"


@query(rf"""
WITH t AS (SELECT record_no, canonical_prompt AS a, {_TRANSLATED} AS b FROM inventory)
SELECT record_no FROM t WHERE length(trim(a)) > 0 AND length(trim(b)) > 0 AND length(trim(b)) BETWEEN 0.4 * length(trim(a)) AND 2.5 * length(trim(a))
 AND list_sort(regexp_extract_all(a, '\p{{Nd}}+(?:\.\p{{Nd}}+)?')) = list_sort(regexp_extract_all(b, '\p{{Nd}}+(?:\.\p{{Nd}}+)?'))""")
def translation_filter(spark, d):
    """Prompts beside changed ones in place of translations: which pairs can be kept."""
    made = F.expr(_TRANSLATED.replace("'x', 'g'", "'x'").replace("'[a-z]'", "r'[a-z]'"))
    return table(spark, d, "inventory").where(selection.translated_well(F.col("canonical_prompt"), made)).select("record_no")


# Selection rules

_TYPES = "[" + ", ".join(map(quoted, vocab.ERROR_TYPES)) + "]"


@query(f"""
SELECT item_id, t AS error_type, CASE WHEN t IN ('arithmetic_error', 'transcription_error') THEN 'procedural'
 WHEN t IN ('concept_confusion', 'wrong_assumption', 'causal_reversal', 'category_error', 'conservation_error', 'equilibrium_error', 'formula_selection_error', 'sign_convention_error', 'coordinate_choice_error') THEN 'conceptual' END AS error_class
FROM (SELECT item_id, {_TYPES}[1 + item_id % {len(vocab.ERROR_TYPES)}] AS t FROM eval_items)""")
def default_error_classes(spark, d):
    kind = F.element_at(F.array(*map(F.lit, vocab.ERROR_TYPES)), (F.col("item_id") % len(vocab.ERROR_TYPES) + 1).cast("int"))
    return table(spark, d, "eval_items").select("item_id", kind.alias("error_type"), selection.default_error_class(kind).alias("error_class"))


@query("""
WITH r AS (SELECT record_no, subject, grade_band, template_fingerprint, source_id, count(*) OVER (PARTITION BY subject, source_id) AS rarity FROM inventory WHERE subject IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY subject, grade_band ORDER BY rarity, record_no) AS k FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY subject, template_fingerprint ORDER BY rarity, record_no) AS k2 FROM a WHERE k <= 60),
c AS (SELECT *, row_number() OVER (PARTITION BY subject, source_id ORDER BY rarity, record_no) AS k3 FROM b WHERE k2 <= 20),
e AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY rarity, record_no) AS k4 FROM c WHERE k3 <= 40)
SELECT record_no FROM e WHERE k4 <= 100""")
def capped_selection(spark, d):
    """A hundred records a subject, rare sources first, at most 60 % of a grade band, 20 % of a template and 40 % of a source."""
    rows = selection.rarity(table(spark, d, "inventory").where("subject is not null"), ["subject"], "source_id")
    caps = {"grade_band": 0.6, "template_fingerprint": 0.2, "source_id": 0.4}
    return selection.within_caps(rows, ["subject"], F.lit(100), caps, [F.col("rarity"), F.col("record_no")]).select("record_no")


def _controller() -> str:
    steps = []
    for k in range(1, 5):
        left = "".join(f" AND record_no NOT IN (SELECT record_no FROM k{j})" for j in range(1, k))
        steps.append(f"k{k} AS (SELECT record_no, subject, behavior AS option FROM (SELECT record_no, subject, behavior, target, row_number() OVER (PARTITION BY subject ORDER BY record_no) AS r FROM c JOIN t USING (subject, behavior) WHERE turn = {k}{left}) WHERE r <= target)")
    return (
        "WITH c AS (SELECT record_no, subject, unnest(list_distinct(eligible_behaviors)) AS behavior FROM inventory), "
        "n AS (SELECT subject, behavior, count(*) AS n FROM c GROUP BY ALL), "
        "t AS (SELECT b.subject, b.behavior, minimum_examples AS target, row_number() OVER (PARTITION BY b.subject ORDER BY coalesce(n, 0) / minimum_examples, b.behavior) AS turn FROM balanced_tutoring_v8 b LEFT JOIN n ON n.subject = b.subject AND n.behavior = b.behavior WHERE minimum_examples > 0), "
        + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(1, 5))
    )


@query(_controller())
def quota_controller(spark, d):
    """One behavior for each record that a cell of its subject still needs, scarce cells first."""
    targets = table(spark, d, "balanced_tutoring_v8").select("subject", F.col("behavior").alias("option"), F.col("minimum_examples").alias("target"))
    inv = table(spark, d, "inventory").select("record_no", "subject", "eligible_behaviors")
    return selection.quota_controller(inv, targets, "record_no", "subject", "eligible_behaviors", [F.col("record_no")])


@query("""
WITH m AS (SELECT dataset AS key, min(s) AS v FROM (SELECT lower(trim(dataset)) AS dataset, capabilities.subjects[1] AS s FROM sources WHERE len(capabilities.subjects) = 1) WHERE s IS NOT NULL AND dataset IS NOT NULL GROUP BY 1 HAVING min(s) = max(s)),
i AS (SELECT record_no, i.subject, canonical_prompt AS p, m.v FROM inventory i LEFT JOIN sources s ON s.id = i.source_id LEFT JOIN m ON m.key = lower(trim(s.dataset)))
SELECT record_no, coalesce(own, v, word) AS routed, CASE WHEN own IS NOT NULL THEN 'metadata' WHEN v IS NOT NULL THEN 'mapping' WHEN word IS NOT NULL THEN 'keyword' ELSE 'unresolved' END AS routed_by
FROM (SELECT record_no, v, CASE WHEN subject IN ('math', 'physics', 'chemistry', 'biology', 'earth_science') THEN subject END AS own,
  CASE WHEN regexp_matches(p, 'voltage|pulley|ammeter') THEN 'physics' WHEN regexp_matches(p, 'product|sum|ratio') THEN 'math' END AS word FROM i)""")
def subject_routing(spark, d):
    """Subjects by metadata, else by the dataset's one subject, else by keywords."""
    key = F.lower(F.trim("dataset"))
    of = table(spark, d, "sources").select(F.col("id").alias("source_id"), key.alias("key"), "capabilities")
    mapping = of.where(F.size("capabilities.subjects") == 1).select("key", F.col("capabilities.subjects")[0].alias("value"))
    rows = table(spark, d, "inventory").join(selection.small(of.select("source_id", "key")), "source_id", "left")
    out = selection.routed(rows, "subject", list(vocab.SUBJECTS), mapping, "key", [("voltage|pulley|ammeter", "physics"), ("product|sum|ratio", "math")], "canonical_prompt")
    return out.select("record_no", "routed", "routed_by")


@query("""
SELECT l_orderkey, l_linenumber, a + b + c + e >= 5 AND a > 0 AND b > 0 AS good, CASE WHEN l_quantity >= 40 THEN 'accept' WHEN l_quantity >= 25 THEN 'review' WHEN l_quantity IS NOT NULL THEN 'reject' END AS band
FROM (SELECT *, l_linenumber % 3 AS a, l_orderkey % 3 AS b, l_partkey % 3 AS c, l_suppkey % 3 AS e FROM lineitem)""")
def quality_bands(spark, d):
    """Scores of 0 to 2 that must add up to 5, two of them above 0, and a measure's band of doubt."""
    scores = {k: F.col(c) % 3 for k, c in zip("abce", ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"))}
    rows = table(spark, d, "lineitem").withColumns(scores)
    return rows.select("l_orderkey", "l_linenumber", selection.quality(list(scores), 5, ["a", "b"]).alias("good"), selection.band(F.col("l_quantity"), 25, 40).alias("band"))


@query("SELECT DISTINCT CASE WHEN (SELECT count(*) FROM eval_items) >= 1500 THEN 'first' ELSE 'second' END AS chosen FROM eval_items")
def fallback_source(spark, d):
    """The items if there are 1,500 of them, else the inventory."""
    mark = lambda df, name: df.select(F.lit(name).alias("chosen"))
    return selection.fallback(mark(table(spark, d, "eval_items"), "first"), mark(table(spark, d, "inventory"), "second")).distinct()


@query("SELECT p_partkey, round(0.6 * p_size / 15.0 + 0.4 * p_retailprice / 7000.0, 6) AS worth FROM part")
def break_even(spark, d):
    worth = scoring.break_even(F.col("p_size") / 15.0, F.col("p_retailprice") / 7000.0)
    return table(spark, d, "part").select("p_partkey", F.round(worth, 6).alias("worth"))


@query("""
WITH n AS (SELECT least(min(n), 500) AS n FROM (SELECT count(*) AS n FROM inventory WHERE subject IN ('math', 'physics', 'chemistry') GROUP BY subject))
SELECT record_no FROM (SELECT record_no, row_number() OVER (PARTITION BY subject ORDER BY record_no) AS r FROM inventory WHERE subject IN ('math', 'physics', 'chemistry')) WHERE r <= (SELECT CASE WHEN n >= 10 THEN n ELSE 0 END FROM n)""")
def balanced_ranks(spark, d):
    """As many records of three subjects each as the smallest can give."""
    rows = table(spark, d, "inventory").where(F.col("subject").isin("math", "physics", "chemistry"))
    return selection.resized(rows, ["subject"], [F.col("record_no")], least=10)[0].select("record_no")


_MEMBER = "lower(trim(membership))"


@query(f"""
WITH r AS (SELECT * FROM training_rows), m AS (SELECT DISTINCT build_name, row_id, {_MEMBER} AS membership, exposure_count FROM build_membership),
f AS (SELECT m.build_name, r.family_id, bool_or(m.membership = 'evaluation') AS e, bool_or(m.membership <> 'evaluation') AS o FROM m JOIN (SELECT DISTINCT row_id, family_id FROM r) r USING (row_id) WHERE family_id IS NOT NULL AND membership IS NOT NULL GROUP BY ALL)
SELECT 'row_id_twice' AS gate, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM r WHERE row_id IS NOT NULL GROUP BY row_id))::BIGINT AS violations
UNION ALL SELECT 'variant_twice', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM r WHERE family_id IS NOT NULL AND selected_behavior IS NOT NULL AND constraint_signature IS NOT NULL AND renderer_version IS NOT NULL GROUP BY family_id, selected_behavior, constraint_signature, renderer_version))
UNION ALL SELECT 'more_than_two_behaviors', (SELECT count(*) FROM (SELECT family_id FROM r WHERE family_id IS NOT NULL GROUP BY family_id HAVING count(DISTINCT selected_behavior) > 2))
UNION ALL SELECT 'mini_train_repeated', (SELECT count(*) FROM m WHERE membership = 'mini_train' AND exposure_count > 1)
UNION ALL SELECT 'family_crosses_boundary', (SELECT count(*) FROM f WHERE e AND o)
UNION ALL SELECT 'content_in_both', (SELECT count(*) FROM (SELECT canonical_content_hash FROM r JOIN m USING (row_id) WHERE canonical_content_hash IS NOT NULL GROUP BY canonical_content_hash HAVING bool_or(m.membership = 'evaluation') AND bool_or(m.membership <> 'evaluation')))
UNION ALL SELECT 'same_content_twice', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM r WHERE canonical_content_hash IS NOT NULL GROUP BY canonical_content_hash))""")
def release_gates(spark, d):
    """Zero-count gates of a build over its registry: repeated keys and contents, crowded families, what crosses into the evaluation."""
    r, m = table(spark, d, "training_rows"), table(spark, d, "build_membership")
    m = m.select("build_name", "row_id", F.lower(F.trim("membership")).alias("membership"), "exposure_count").distinct()
    evaluation, other = F.bool_or(F.col("membership") == "evaluation"), F.bool_or(F.col("membership") != "evaluation")
    extra = lambda *keys: r.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("violations"))
    family = m.dropna(subset=["membership"]).join(r.select("row_id", "family_id").distinct().dropna(), "row_id").groupBy("build_name", "family_id").agg(evaluation.alias("e"), other.alias("o"))
    content = r.select("row_id", "canonical_content_hash").dropna().join(m, "row_id").groupBy("canonical_content_hash").agg(evaluation.alias("e"), other.alias("o"))
    gates = {
        "row_id_twice": extra("row_id"),
        "variant_twice": extra("family_id", "selected_behavior", "constraint_signature", "renderer_version"),
        "more_than_two_behaviors": count(r.dropna(subset=["family_id"]).groupBy("family_id").agg(F.count_distinct("selected_behavior").alias("n")).where("n > 2")),
        "mini_train_repeated": count(m.where("membership = 'mini_train' and exposure_count > 1")),
        "family_crosses_boundary": count(family.where("e and o")),
        "content_in_both": count(content.where("e and o")),
        "same_content_twice": extra("canonical_content_hash"),
    }
    out = None
    for name, n in gates.items():
        one = n.select(F.lit(name).alias("gate"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


# Records of other shapes


@query("""
SELECT item_id, CASE item_id % 6 WHEN 0 THEN text || chr(10) || subject WHEN 1 THEN text || chr(10) || '["a","b"]' WHEN 2 THEN text || chr(10) || subject WHEN 3 THEN text || chr(10) || subject WHEN 4 THEN text ELSE text || chr(10) || subject END AS v1,
 CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text WHEN 3 THEN '{"am":' || to_json(subject) || ',"en":' || to_json(text) || '}' WHEN 4 THEN text ELSE '{"hypothesis":' || to_json(subject) || ',"premise":' || to_json(text) || '}' END AS v0 FROM eval_items""")
def prompt_branches(spark, d):
    """Prompts out of records of each shape: messages, examples with choices, premises, language pairs, single fields."""
    t, s = F.col("text"), F.col("subject")
    message = lambda c: F.struct(F.lit("user").alias("role"), c.alias("content"))
    shapes = [
        F.to_json(F.struct(F.array(message(t), message(s)).alias("messages"))),
        F.to_json(F.struct(F.struct(t.alias("question"), F.array(F.lit("a"), F.lit("b")).alias("choices")).alias("example"))),
        F.to_json(F.struct(F.struct(t.alias("premise"), s.alias("hypothesis")).alias("example"))),
        F.to_json(F.struct(t.alias("en"), s.alias("am"))),
        F.to_json(F.struct(t.alias("question"), s.alias("text"))),
        F.to_json(F.struct(t.alias("premise"), s.alias("hypothesis"))),
    ]
    record = F.element_at(F.array(*shapes), (F.col("item_id") % 6 + 1).cast("int"))
    return table(spark, d, "eval_items").select("item_id", prompts.prompt_v1(record).alias("v1"), prompts.prompt_v0(record).alias("v0"))


@query(f"SELECT item_id, {sha('generator-family', 'suite', 'subject')} AS family_id FROM eval_items")
def generated_families(spark, d):
    """Families of generated records: by template version and context."""
    none = F.lit(None).cast("string")
    return table(spark, d, "eval_items").select("item_id", identity.family_id(none, F.col("suite"), F.col("subject")).alias("family_id"))


@query("""SELECT item_id, '{"a":' || to_json(subject) || ',"b":{"c":' || item_id || ',"d":[1,2.5]},"z":null}' AS form FROM eval_items""")
def stable_json_forms(spark, d):
    """JSON with unsorted keys and spaces in its one stable form."""
    raw = F.concat(F.lit('{ "z": null, "b": {"d": [1, 2.5], "c": '), F.col("item_id").cast("string"), F.lit('}, "a": "'), F.col("subject"), F.lit('" }'))
    return table(spark, d, "eval_items").select("item_id", identity.stable_json(raw).alias("form"))


@query("""
SELECT item_id, 'sha256:' || sha256('constraints' || chr(31) || 'norm-v1' || chr(31) || '[{"id":"behavior","parameters":{"n":' || item_id || ',"value":"' || behavior || '"}},{"id":"subject","parameters":{}}]') AS signature FROM eval_items""")
def constraint_signatures_json(spark, d):
    """Signatures of constraints given as JSON, with parameters of several types, or none."""
    items = F.concat(F.lit('[{"id": "subject"}, {"parameters": {"value": "'), F.col("behavior"), F.lit('", "n": '), F.col("item_id").cast("string"), F.lit('}, "id": "behavior"}]'))
    return table(spark, d, "eval_items").select("item_id", identity.constraint_signature(items).alias("signature"))


@query("""
SELECT item_id, name, CASE name WHEN 'long_enough' THEN length(text) > 60 WHEN 'has_question' THEN contains(text, '?') ELSE false END AS met FROM eval_items, (VALUES ('long_enough'), ('has_question'), ('never_heard_of')) n(name)""")
def registered_checks(spark, d):
    """Checks by name, one of them registered here, one unknown and so never met."""
    checklist.register("long_enough", lambda t: F.length(t) > 60)
    try:
        each = table(spark, d, "eval_items").select("item_id", "text", F.explode(F.array(*map(F.lit, ("long_enough", "has_question", "never_heard_of")))).alias("name"))
        return each.select("item_id", "name", checklist.check_named(F.col("name"), F.col("text")).alias("met"))
    finally:
        del checklist.CHECKS["long_enough"]


@query("""
SELECT 'authored_hint_0000' || i AS id, 'hint' AS behavior, 'Think about ' || t || ' in ' || p || '.' AS user, a AS assistant
FROM (VALUES (0, 'heat', 'a kettle', 'What moves?'), (1, 'force', 'a swing', 'What pulls?')) v(i, t, p, a)""")
def authored_rows(spark, d):
    """Rows from a template and a table of what fills it."""
    rows = mix.from_templates(spark, [("heat", "a kettle", "What moves?"), ("force", "a swing", "What pulls?")], ["topic", "place", "assistant"], "Think about %s in %s.", ["topic", "place"], "hint")
    return rows.select("id", "behavior", F.col("messages")[0]["content"].alias("user"), F.col("messages")[1]["content"].alias("assistant"))


@query("SELECT count(*) AS passed FROM documents")
def firewall_bypass(spark, d):
    """With the firewall skipped every candidate passes."""
    return firewall.survivors_v0(table(spark, d, "documents"), table(spark, d, "eval_items"), skip=True).agg(F.count(F.lit(1)).alias("passed"))


@query("SELECT id, CASE WHEN coalesce(inventory_path, '') = '' THEN 'not_configured' ELSE 'missing' END AS status FROM sources")
def inventory_paths(spark, d):
    """Whether each source's inventory is there, by the manifest's paths below a folder that holds none."""
    rows = table(spark, d, "sources").select("id", "inventory_path").collect()  # a manifest of 25 sources
    found = [(r.id, readers.inventory_status(spark, r.inventory_path, f"{d}/none")[0]) for r in rows]
    return spark.createDataFrame(found, "id string, status string")


@query("""
SELECT export_profile, sp AS split, count(*) AS row_count, count(DISTINCT family_id) AS families FROM (SELECT s.export_profile, lower(trim(i.source_split)) AS sp, i.family_id FROM inventory i JOIN sources s ON s.id = i.source_id) GROUP BY ALL""")
def license_report(spark, d):
    """Rows and families by license profile and split as written."""
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "export_profile")
    rows = table(spark, d, "inventory").join(selection.small(s), "source_id").withColumn("split", F.lower(F.trim("source_split")))
    return rows.groupBy("export_profile", "split").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("family_id").alias("families"))


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling_stream(spark, d):
    """The hourly counts of the events read as a stream, with state and a watermark wide enough for all of them."""
    base = f"{scratch.root(spark)}/windows-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = runlog.windowed_counts(events, window="1 hour", late="3650 days")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/part={number}")

    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out").groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "part").alias("s"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "s.n", F.round("s.total", 4).alias("total"))


@query("""
SELECT item_id, CASE item_id % 6 WHEN 0 THEN behavior WHEN 1 THEN subject WHEN 2 THEN subject WHEN 3 THEN subject WHEN 4 THEN '7' ELSE '' END AS gold FROM eval_items""")
def gold_answers(spark, d):
    """Gold answers as given, else from a raw record's number, answer, target or label, else empty."""
    s = F.col("subject")
    raws = [F.to_json(F.struct(s.alias("target"))), F.to_json(F.struct(s.alias("answer"), F.lit("x").alias("label"))), F.to_json(F.struct(F.lit(" ").alias("answer"), s.alias("target"))), F.to_json(F.struct(s.alias("label"))), F.to_json(F.struct(F.lit(7).alias("answer_number"), s.alias("answer"))), F.lit("{}")]
    raw = F.element_at(F.array(*raws), (F.col("item_id") % 6 + 1).cast("int"))
    given = F.when(F.col("item_id") % 6 == 0, F.col("behavior")).otherwise(" ")
    return table(spark, d, "eval_items").select("item_id", prompts.gold_answer(given, raw).alias("gold"))


@query(f"""
WITH b AS (SELECT count(*) AS n FROM documents WHERE {norm1('text')} IN (SELECT {norm1('text')} FROM eval_items) OR {template('text')} IN (SELECT {template('text')} FROM eval_items))
SELECT CASE WHEN n > 0 THEN 'refused' ELSE 'allowed' END AS outcome, 'allowed' AS without_them FROM b""")
def firewall_assertion(spark, d):
    """Whether the documents may be candidates: refused if any equals a frozen item, and allowed once all that hit are left out."""
    items = table(spark, d, "eval_items").select(F.col("text").alias("prompt"))
    sets = firewall.hash_sets(firewall.freeze(items))
    docs = firewall.hashed(table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt")))

    def outcome(df):
        try:
            firewall.assert_allowed(df, *sets)
            return "allowed"
        except ValueError:
            return "refused"

    rest = firewall.check(docs, *sets).where("decision.allowed").drop("decision")
    return spark.createDataFrame([(outcome(docs), outcome(rest))], "outcome string, without_them string")
