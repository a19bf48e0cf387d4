"""Validation rules as data, compiled into one column of issues.

All rules of a stage are evaluated; a later stage counts only where the earlier ones
found nothing, as checks across fields presuppose valid fields; within a
stage marked ``first``, only the first broken rule of each group counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from sedgeline import vocab
from sedgeline.functions import prompts, text


@dataclass(frozen=True)
class Rule:
    """broken: the condition under which the rule is broken, null meaning not. stage: the order of
    evaluation; group: rules of which only the first broken one counts; schema: what the rule is in a JSON Schema."""

    location: str
    kind: str
    message: str
    broken: Callable[[], Column]
    stage: int = 0
    group: str | None = None
    schema: dict | None = None


def compile_issues(rules: Iterable[Rule]) -> Column:
    """array<struct<location, message, kind>> of the rules that a row breaks."""
    rules = list(rules)
    total: Column | None = None
    for stage in sorted({r.stage for r in rules}):
        parts, groups = [], {}
        for r in (r for r in rules if r.stage == stage):
            hit = F.when(F.coalesce(r.broken(), F.lit(False)), F.struct(F.lit(r.location).alias("location"), F.lit(r.message).alias("message"), F.lit(r.kind).alias("kind")))
            if r.group is None:
                parts.append(hit)
            else:
                groups.setdefault(r.group, []).append(hit)
        parts += [F.coalesce(*hits) for hits in groups.values()]
        found = F.array_compact(F.array(*parts))
        total = found if total is None else F.when(F.size(total) == 0, found).otherwise(total)
    return total if total is not None else F.array().cast("array<struct<location:string,message:string,kind:string>>")


def missing(path: str) -> Rule:
    return Rule(path, "missing", "Field required", lambda: F.col(path).isNull())


def filled(path: str) -> Rule:
    return Rule(path, "string_too_short", "String should have at least 1 character", lambda: F.length(F.trim(path)) == 0, schema={"minLength": 1})


def one_of(path: str, values: Iterable[str]) -> Rule:
    values = tuple(values)
    return Rule(path, "literal_error", "Input should be " + ", ".join(map(repr, values)), lambda: ~F.col(path).isin(*values), schema={"enum": list(values)})


def each_of(path: str, values: Iterable[str], field: str | None = None) -> Rule:
    """As ``one_of``, for the strings of a list, or a field of the structs of a list; nulls in it are broken too."""
    values = tuple(values)
    of = lambda x: x if field is None else x[field]
    name = path if field is None else f"{path}[].{field}"
    return Rule(name, "literal_error", "Input should be " + ", ".join(map(repr, values)), lambda: F.exists(path, lambda x: ~F.coalesce(of(x).isin(*values), F.lit(False))))


def each_filled(path: str, field: str) -> Rule:
    """Whether a field of the structs of a list is there and not blank."""
    return Rule(f"{path}[].{field}", "string_too_short", "String should have at least 1 character", lambda: F.exists(path, lambda x: F.coalesce(F.length(F.trim(x[field])), F.lit(0)) == 0))


def between(path: str, low: float | None = None, high: float | None = None) -> list[Rule]:
    out = []
    if low is not None:
        out.append(Rule(path, "greater_than_equal", f"Input should be greater than or equal to {low:g}", lambda: F.col(path) < low, schema={"minimum": low}))
    if high is not None:
        out.append(Rule(path, "less_than_equal", f"Input should be less than or equal to {high:g}", lambda: F.col(path) > high, schema={"maximum": high}))
    return out


def hash_form(path: str) -> Rule:
    return Rule(path, "string_pattern_mismatch", "String should be sha256: and 64 hexadecimal digits", lambda: ~F.col(path).rlike(r"^sha256:[0-9a-f]{64}\z"), schema={"pattern": "^sha256:[0-9a-f]{64}$"})


def sized(path: str, low: int, high: int | None = None) -> list[Rule]:
    out = [Rule(path, "too_short", f"List should have at least {low} items", lambda: F.size(path) < low, schema={"minItems": low})]
    return out if high is None else [*out, Rule(path, "too_long", f"List should have at most {high} items", lambda: F.size(path) > high, schema={"maxItems": high})]


def unknown_keys(raw: Column, allowed: Iterable[str]) -> Column:
    """The top-level keys of a JSON object that aren't allowed."""
    return F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, allowed)))


def unknown_paths(raw: Column, kind: DataType, prefix: str = "") -> Column:
    """The paths of all keys of a JSON value that a schema lacks, at every level: within structs, the
    structs of lists (``a[].b``) and of maps (``a{}.b``)."""
    none = F.array().cast("array<string>")
    if isinstance(kind, ArrayType) or isinstance(kind, MapType):
        inner, mark = (kind.elementType, "[]") if isinstance(kind, ArrayType) else (kind.valueType, "{}")
        if not _has_struct(inner):
            return none
        parsed = F.from_json(raw, "array<string>" if isinstance(kind, ArrayType) else "map<string,string>")
        values = parsed if isinstance(kind, ArrayType) else F.map_values(parsed)
        each = F.flatten(F.transform(values, lambda v: unknown_paths(v, inner, f"{prefix}{mark}")))
        return F.array_distinct(F.coalesce(each, none))
    if not isinstance(kind, StructType):
        return none
    dot = f"{prefix}." if prefix else ""
    own = F.transform(F.coalesce(unknown_keys(raw, kind.fieldNames()), none), lambda k: F.concat(F.lit(dot), k))
    parts = [unknown_paths(F.get_json_object(raw, f"$['{f.name}']"), f.dataType, f"{dot}{f.name}") for f in kind.fields if _has_struct(f.dataType)]
    return F.concat(own, *parts)


def _has_struct(kind: DataType) -> bool:
    if isinstance(kind, ArrayType) or isinstance(kind, MapType):
        return _has_struct(kind.elementType if isinstance(kind, ArrayType) else kind.valueType)
    return isinstance(kind, StructType)


def stripped(c: Column, kind: DataType) -> Column:
    """A value with all its strings trimmed, at every level; map keys stay."""
    if isinstance(kind, StringType):
        return F.regexp_replace(c, rf"(?U)\A{text.SPACE}+|{text.SPACE}+\z", "")
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: stripped(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda k, v: stripped(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(stripped(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def strict(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """JSON records of a column ``raw`` as the columns of a schema, strings trimmed, beside the other columns and
    ``unknown``, the paths of keys that the schema lacks, and ``malformed``: no object, or a value of another type."""
    kind = df.sparkSession.createDataFrame([], schema).schema
    held = StructType([*kind.fields, StructField("_corrupt", StringType())])
    parsed = df.withColumn("_r", F.from_json(raw, held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    others = [c for c in df.columns if c != raw]
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    bad = ~is_object | F.coalesce(F.col("_r")["_corrupt"].isNotNull(), F.lit(False))
    unknown = F.when(is_object, unknown_paths(F.col(raw), kind)).otherwise(F.array().cast("array<string>"))
    return parsed.select(*others, *(stripped(F.col("_r")[f.name], f.dataType).alias(f.name) for f in kind.fields), unknown.alias("unknown"), bad.alias("malformed"))


def strict_issues(rules: Iterable[Rule]) -> Column:
    """The issues of a record as read by ``strict``: malformed records have this one; unknown keys count among
    the first stage's, so rules across fields are left out then."""
    form = lambda location, kind, message: F.struct(location.alias("location"), F.lit(message).alias("message"), F.lit(kind).alias("kind"))
    extra = F.transform("unknown", lambda k: form(k, "extra_forbidden", "Extra inputs are not permitted"))
    first = [r for r in rules if r.stage == 0]
    own = F.concat(compile_issues(first), extra)
    later = compile_issues([r for r in rules if r.stage > 0])
    return F.when(F.col("malformed"), F.array(form(F.lit(""), "model_type", "Input should be a record of the schema"))).when(F.size(own) > 0, own).otherwise(later)


def numbered_location(index: Column, location: Column) -> Column:
    """``record[i].location``, i from 1; ``record[i]`` for an issue of the whole record."""
    head = F.concat(F.lit("record["), index.cast("string"), F.lit("]"))
    return F.when(location == "", head).otherwise(F.concat(head, F.lit("."), location))


def no_artifacts(path: str, stage: int) -> Rule:
    return Rule(path, "source_artifact", "banned source artifact", lambda: text.find_artifact(F.col(path)).isNotNull(), stage)


def _cross(location: str, message: str, broken: Callable[[], Column], group: str | None = None, stage: int = 1) -> Rule:
    return Rule(location, "value_error", message, broken, stage, group)


def _in(name: str, fields: str) -> str:
    return f"{name} struct<{fields}>"


#: The columns of a canonical training record.
CANONICAL = ", ".join((
    "schema_version string, id string, split string",
    _in("source", "dataset string, revision string, config string, source_split string, original_id string, url string, license string, license_class string, export_profile string, transformation string"),
    _in("curriculum", "subject string, secondary_subjects array<string>, topic string, subtopic string, grade_band string, difficulty string, learning_objective string"),
    _in("pedagogy", "behavior string, teacher_move string, intent string, principles array<string>, answer_policy string, question_count bigint, interaction_mode string"),
    _in("grounding", "problem string, canonical_answer string, solution_steps array<string>, supporting_facts array<string>, reference_explanation string, equations array<string>, units array<string>, accepted_variants array<string>"),
    _in("student_state", "attempt string, first_error_step bigint, error_type string, error_class string, error_class_rationale string, misconception string"),
    _in("constraints", "items array<struct<id string, check string, parameters map<string,string>>>, forbidden_answers array<string>, constraint_results map<string,struct<passed boolean, observed string, matched_variants array<string>, notes string>>, all_constraints_pass boolean"),
    "messages array<struct<role string, content string>>",
    _in("quality", "generator string, verifiers array<string>, factual_score double, pedagogy_score double, constraint_pass boolean, curator_review string, curator_model string, model_independence string, review_passes bigint, assurance_tier string, "
        "selection struct<decision string, subject_method string, subject_distribution map<string,double>, subject_choice_confidence double, behavior_eligibility map<string,struct<eligible boolean, p_yes double, method string>>, behavior_classifier string, typesafe_sdk string, selected_behavior string, "
        "scores struct<grounding bigint, answer_verifiability bigint, curriculum_fit bigint, behavior_affordance bigint, clarity bigint, diversity_value bigint>, total bigint, rejection_reasons array<string>>"),
    _in("identity", "source_key string, family_id string, row_id string, record_version bigint, parent_row_ids array<string>"),
    _in("dedup", "normalization_version string, canonical_content_hash string, prompt_hash string, assistant_hash string, constraint_signature string, template_fingerprint string, semantic_cluster_id string, nearest_eval_similarity double, duplicate_of string, decision string"),
))


def canonical_rules(schema_version: str | None = None) -> list[Rule]:
    """The rules of a canonical training record, nested as structs of the same names; schema_version: the
    one that records must state, None for any."""
    c = F.col
    strings = [f"source.{x}" for x in ("dataset", "revision", "config", "source_split", "original_id", "url", "license", "transformation")]
    strings += ["id", "curriculum.topic", "curriculum.learning_objective", "grounding.problem", "identity.source_key", "dedup.normalization_version"]
    enums = {
        "split": vocab.SPLITS,
        "source.license_class": vocab.LICENSE_CLASSES[:4],
        "source.export_profile": vocab.EXPORT_PROFILES[:4],
        "curriculum.subject": vocab.SUBJECTS,
        "curriculum.grade_band": (vocab.GRADE_BAND,),
        "curriculum.difficulty": vocab.DIFFICULTIES,
        "pedagogy.behavior": vocab.BEHAVIORS,
        "pedagogy.teacher_move": tuple(vocab.MOVE_INTENTS),
        "pedagogy.intent": tuple(i for v in vocab.MOVE_INTENTS.values() for i in v),
        "pedagogy.answer_policy": vocab.ANSWER_POLICIES,
        "pedagogy.interaction_mode": vocab.INTERACTION_MODES,
        "student_state.error_type": vocab.ERROR_TYPES,
        "student_state.error_class": vocab.ERROR_CLASSES,
        "quality.selection.selected_behavior": vocab.BEHAVIORS,
        "quality.selection.decision": vocab.SELECTION_DECISIONS,
        "quality.selection.subject_method": vocab.SUBJECT_METHODS,
        "quality.curator_review": vocab.CURATOR_REVIEWS,
        "quality.model_independence": vocab.MODEL_INDEPENDENCE,
        "quality.assurance_tier": vocab.ASSURANCE_TIERS,
        "dedup.decision": vocab.DEDUP_DECISIONS,
    }
    if schema_version is not None:
        enums["schema_version"] = (schema_version,)
    scores = [f"quality.selection.scores.{s}" for s in ("grounding", "answer_verifiability", "curriculum_fit", "behavior_affordance", "clarity", "diversity_value")]
    rules = [r for s in strings for r in (missing(s), filled(s))]
    rules += [r for path, values in enums.items() for r in ([] if path.startswith("student_state") else [missing(path)]) + [one_of(path, values)]]
    for path, low, high in (("pedagogy.question_count", 0, None), ("student_state.first_error_step", 1, None), ("quality.factual_score", 0, 1), ("quality.pedagogy_score", 0, 1), ("quality.review_passes", 0, None), ("quality.selection.total", 0, 12), ("identity.record_version", 1, None), ("dedup.nearest_eval_similarity", 0, 1), ("quality.selection.subject_choice_confidence", 0, 1), *((s, 0, 2) for s in scores)):
        rules += between(path, low, high)
    required = ("schema_version", "constraints.all_constraints_pass", "constraints.constraint_results", "constraints.items", "messages", "pedagogy.question_count", "quality.generator", "quality.verifiers", "quality.factual_score", "quality.pedagogy_score", "quality.constraint_pass", "quality.review_passes", "quality.selection.behavior_eligibility", "quality.selection.behavior_classifier", "quality.selection.total", "identity.record_version", *scores)
    rules += [missing(x) for x in required if x not in enums]
    state = lambda x: Rule(f"student_state.{x}", "missing", "Field required", lambda: c("student_state").isNotNull() & c(f"student_state.{x}").isNull())
    rules += [r for x in ("attempt", "error_class_rationale", "misconception") for r in (state(x), filled(f"student_state.{x}"))] + [state("error_type")]
    rules += [each_of("curriculum.secondary_subjects", vocab.SUBJECTS), each_of("pedagogy.principles", vocab.PRINCIPLES), each_of("messages", vocab.ROLES, "role")]
    rules += [each_filled("messages", "content"), each_filled("constraints.items", "id"), each_filled("constraints.items", "check")]
    methods, p = (vocab.METHOD_PROBABILITY, vocab.METHOD_RULE), lambda e: e["p_yes"]
    eligibility = lambda test: lambda: F.exists(F.map_values("quality.selection.behavior_eligibility"), test)
    rules += [
        Rule("quality.selection.behavior_eligibility{}.method", "literal_error", "Input should be " + ", ".join(map(repr, methods)), eligibility(lambda e: ~F.coalesce(e["method"].isin(*methods), F.lit(False)))),
        Rule("quality.selection.behavior_eligibility{}.eligible", "missing", "Field required", eligibility(lambda e: e["eligible"].isNull())),
        Rule("quality.selection.behavior_eligibility{}.p_yes", "greater_than_equal", "Input should be greater than or equal to 0", eligibility(lambda e: F.coalesce(p(e) < 0, F.lit(False)))),
        Rule("quality.selection.behavior_eligibility{}.p_yes", "less_than_equal", "Input should be less than or equal to 1", eligibility(lambda e: F.coalesce(p(e) > 1, F.lit(False)))),
    ]
    rules += [hash_form(f"identity.{x}") for x in ("family_id", "row_id")]
    rules += [hash_form(f"dedup.{x}") for x in ("canonical_content_hash", "prompt_hash", "assistant_hash", "constraint_signature", "template_fingerprint")]
    rules += [*sized("constraints.items", 1), *sized("messages", 2, 3), *sized("quality.verifiers", 1)]
    ids = lambda: F.transform("constraints.items", lambda i: i["id"])
    results = lambda: c("constraints.constraint_results")
    sel = "quality.selection"
    choice = lambda: c(f"{sel}.subject_method") == vocab.METHOD_CHOICE
    spread = lambda: c(f"{sel}.subject_distribution")
    eligible = lambda: c(f"{sel}.behavior_eligibility")
    wrong = lambda: c("student_state.error_type") != "none"
    rules += [
        _cross("curriculum", "primary subject cannot also be secondary", lambda: F.array_contains("curriculum.secondary_subjects", c("curriculum.subject")), "curriculum"),
        _cross("curriculum", "secondary subjects must be unique", lambda: ~prompts.distinct_items(c("curriculum.secondary_subjects")), "curriculum"),
        _cross("pedagogy", "intent is not one of its move's", lambda: ~prompts.intent_allowed(c("pedagogy.teacher_move"), c("pedagogy.intent"))),
        _cross("student_state", "a correct attempt has no error step and class", lambda: ~wrong() & (c("student_state.first_error_step").isNotNull() | c("student_state.error_class").isNotNull())),
        _cross("student_state", "a wrong attempt has an error step and class", lambda: wrong() & (c("student_state.first_error_step").isNull() | c("student_state.error_class").isNull())),
        _cross("constraints", "constraint ids must be unique", lambda: ~prompts.distinct_items(ids()), "constraints"),
        _cross("constraints", "results must be those of the constraint ids", lambda: ~prompts.same_keys(results(), ids()), "constraints"),
        _cross("constraints", "all_constraints_pass disagrees with the results", lambda: c("constraints.all_constraints_pass") != prompts.all_passed(results()), "constraints"),
        _cross(f"{sel}.behavior_eligibility", "a probability is there for decisions by probability only", lambda: F.exists(F.map_values(eligible()), lambda e: ((e["method"] == vocab.METHOD_PROBABILITY) & e["p_yes"].isNull()) | ((e["method"] == vocab.METHOD_RULE) & e["p_yes"].isNotNull()))),
        _cross(f"{sel}.behavior_eligibility", "exactly the four behaviors", lambda: ~prompts.same_keys(eligible(), F.array(*map(F.lit, vocab.BEHAVIORS)))),
        _cross(sel, "total must be the sum of the scores", lambda: c(f"{sel}.total") != sum((c(s) for s in scores), F.lit(0)), "selection", 2),
        _cross(sel, "the selected behavior must be eligible", lambda: ~F.try_element_at(eligible(), c(f"{sel}.selected_behavior"))["eligible"], "selection", 2),
        _cross(sel, "a choice needs all six probabilities", lambda: choice() & (spread().isNull() | ~prompts.same_keys(spread(), F.array(*map(F.lit, (*vocab.SUBJECTS, "no_match"))))), "selection", 2),
        _cross(sel, "probabilities must add up to 1", lambda: choice() & ~prompts.sums_to(spread()), "selection", 2),
        _cross(sel, "a choice needs a confidence", lambda: choice() & c(f"{sel}.subject_choice_confidence").isNull(), "selection", 2),
        _cross("", "invalid message order", lambda: ~prompts.valid_role_order(c("messages")), "record", 3),
        _cross("", "diagnose needs a student state", lambda: (c("pedagogy.behavior") == "diagnose") & c("student_state").isNull(), "record", 3),
        _cross("", "a student state is for diagnose or hint only", lambda: ~c("pedagogy.behavior").isin("diagnose", "hint") & c("student_state").isNotNull(), "record", 3),
        _cross("", "only explain may omit the answer", lambda: c("grounding.canonical_answer").isNull() & (c("pedagogy.behavior") != "explain"), "record", 3),
        _cross("", "explain without an answer needs facts and an explanation", lambda: c("grounding.canonical_answer").isNull() & ((F.coalesce(F.size("grounding.supporting_facts"), F.lit(0)) < 1) | (F.coalesce(F.length("grounding.reference_explanation"), F.lit(0)) == 0)), "record", 3),
        _cross("", "behavior must be the selected one", lambda: c("pedagogy.behavior") != c(f"{sel}.selected_behavior"), "record", 3),
        _cross("", "constraint_pass disagrees with the constraints", lambda: c("quality.constraint_pass") != c("constraints.all_constraints_pass"), "record", 3),
        no_artifacts("grounding.problem", 4),
        no_artifacts("student_state.attempt", 4),
    ]
    artifact = lambda i: (lambda: text.find_artifact(F.try_element_at("messages", F.lit(i + 1))["content"]).isNotNull())
    return rules + [Rule(f"messages[{i}].content", "source_artifact", "banned source artifact", artifact(i), 4) for i in range(3)]


def source_rules() -> list[Rule]:
    """A source manifest entry: vocabularies, and what an allowed source must have. Unique ids are ``duplicates``."""
    allowed = lambda: F.col("allowed_use")
    return [
        Rule("id", "string_pattern_mismatch", "String should match pattern", lambda: ~F.col("id").rlike(r"^[a-z0-9][a-z0-9_-]+\z")),
        *(missing(x) for x in ("name", "dataset", "url", "config", "imported_split", "license", "license_class", "allowed_use")),
        one_of("license_class", vocab.LICENSE_CLASSES),
        one_of("export_profile", vocab.EXPORT_PROFILES),
        one_of("review_status", vocab.REVIEW_STATUSES),
        _cross("", "allowed sources need a pinned revision", lambda: allowed() & (F.coalesce("revision", F.lit("")) == ""), "allowed"),
        _cross("", "allowed sources must be approved", lambda: allowed() & (F.col("review_status") != "approved"), "allowed"),
        _cross("", "unknown and excluded licenses cannot be allowed", lambda: allowed() & F.col("license_class").isin("unknown", "excluded"), "allowed"),
        _cross("", "allowed sources cannot have an excluded profile", lambda: allowed() & (F.col("export_profile") == "excluded"), "allowed"),
    ]


def inventory_rules() -> list[Rule]:
    known = F.array(*map(F.lit, vocab.BEHAVIORS))
    return [
        *(r for x in ("family_id", "original_id", "canonical_prompt") for r in (missing(x), filled(x))),
        *(missing(x) for x in ("source_id", "source_split", "grade_band", "grounding_available", "license_class", "hard_gate_pass", "subject", "eligible_behaviors")),
        one_of("subject", vocab.SUBJECTS),
        Rule("eligible_behaviors", "literal_error", "Input should be behaviors", lambda: F.size(F.array_except("eligible_behaviors", known)) > 0),
    ]


def issues(df: DataFrame, rules: Iterable[Rule], key: list[str]) -> DataFrame:
    """(key, location, message, kind): one row an issue."""
    return df.select(*key, F.explode(compile_issues(rules)).alias("issue")).select(*key, "issue.*")


def report(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(records_seen, records_valid, issue_count, valid), one row."""
    n = df.select(F.size(compile_issues(rules)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("records_seen"), F.count_if(F.col("n") == 0).alias("records_valid"), F.coalesce(F.sum("n"), F.lit(0)).alias("issue_count")).withColumn("valid", F.col("issue_count") == 0)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, copies): keys that occur more than once; nulls are no keys."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
