"""Evaluation firewall: freeze the hashes of evaluation prompts, keep candidates that hit them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions import identity
from sedgeline.operators.selection import one_row
from sedgeline.scratch import stored
from sedgeline.sizing import small

EXACT, TEMPLATE = "exact_eval_overlap", "template_eval_overlap"


def freeze(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The prompts' rows with their two hashes; null and empty prompts are left out."""
    c = F.col(prompt)
    return prompts.where(F.length(c) > 0).withColumns({"exact_prompt_hash": identity.content_hash(c), "template_fingerprint": identity.template_fingerprint(c)})


def file_stats(prompts: DataFrame, path: str = "path", prompt: str = "prompt") -> DataFrame:
    """(path, rows, prompts_hashed) of each file."""
    return prompts.groupBy(path).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.length(prompt) > 0).alias("prompts_hashed"))


def hash_sets(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct exact hashes and template fingerprints of frozen entries, written once
    so that later checks don't normalize the frozen prompts again."""
    kept = stored(entries.select("exact_prompt_hash", "template_fingerprint"), "frozen")
    return kept.select("exact_prompt_hash").distinct(), kept.select("template_fingerprint").distinct()


def hashed(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """df with the two hashes of its prompts, written once, for ``check`` and for freezing a part of it."""
    return stored(df.withColumns({"exact_prompt_hash": identity.content_hash(F.col(prompt)), "template_fingerprint": identity.template_fingerprint(F.col(prompt))}), "hashed")


def _flag(df: DataFrame, key: Column, hashes: DataFrame, name: str) -> DataFrame:
    """df with a boolean: whether the key is among the hashes; false for null."""
    only = small(hashes.toDF("_frozen").where("_frozen is not null").distinct().withColumn("_hit", F.lit(True)))
    keyed = df.withColumn("_key", key)
    return keyed.join(only, keyed["_key"] == only["_frozen"], "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_key", "_frozen", "_hit")


def check(candidates: DataFrame, exact: DataFrame, templates: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The candidates with ``decision``: allowed, exact_match, template_match and the reasons in this order.

    Null prompts match nothing. Both hashes come from one projection, so texts go to Python once at most; candidates
    that are ``hashed`` already keep theirs.
    """
    if "exact_prompt_hash" in candidates.columns:
        keyed = candidates.withColumns({"_h": F.col("exact_prompt_hash"), "_t": F.col("template_fingerprint")})
    else:
        keyed = candidates.withColumns({"_h": identity.content_hash(F.col(prompt)), "_t": identity.template_fingerprint(F.col(prompt))})
    two = _flag(_flag(keyed, F.col("_h"), exact, "_exact"), F.col("_t"), templates, "_template").drop("_h", "_t")
    reasons = F.array_compact(F.array(F.when(F.col("_exact"), EXACT), F.when(F.col("_template"), TEMPLATE)))
    decision = F.struct((~(F.col("_exact") | F.col("_template"))).alias("allowed"), F.col("_exact").alias("exact_match"), F.col("_template").alias("template_match"), reasons.alias("reasons"))
    return two.withColumn("decision", decision).drop("_exact", "_template")


def assert_allowed(candidates: DataFrame, exact: DataFrame, templates: DataFrame, prompt: str = "prompt") -> None:
    """An error if any candidate overlaps the frozen evaluation."""
    hits = check(candidates, exact, templates, prompt).where("not decision.allowed")
    row = hits.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.flatten(F.collect_set("decision.reasons"))).alias("why")).first()
    if row.n:
        raise ValueError(f"{row.n} training candidates overlap the frozen evaluation: {', '.join(dict.fromkeys(row.why))}")


def flagged_v0(candidates: DataFrame, frozen: DataFrame, text: str = "text", frozen_text: str = "text", skip: bool = False) -> DataFrame:
    """The candidates with ``blocked``: whether their simple normal form is a frozen one. skip passes all."""
    if skip:
        return candidates.withColumn("blocked", F.lit(False))
    return _flag(candidates, identity.hash_v0(F.col(text)), frozen.select(identity.hash_v0(F.col(frozen_text))), "blocked")


def survivors_v0(candidates: DataFrame, frozen: DataFrame, text: str = "text", frozen_text: str = "text", skip: bool = False) -> DataFrame:
    """The candidates whose simple normal form isn't a frozen one (anti join). skip passes all."""
    if skip:
        return candidates
    banned = small(frozen.select(identity.hash_v0(F.col(frozen_text)).alias("_banned")).where("_banned is not null").distinct())
    return candidates.join(banned, identity.hash_v0(F.col(text)) == banned["_banned"], "left_anti")


def gate(judge: DataFrame, rubric: DataFrame, cells: DataFrame, stats: DataFrame, reservations: DataFrame, judge_path: str, expected: int, minimum: int, checks: DataFrame | None = None) -> DataFrame:
    """(check, passed) of the frozen evaluation as a whole.

    judge: (id, prompt, checks); rubric: (name); cells: (subject, behavior, minimum_examples);
    stats: as ``file_stats``; expected: judge rows; minimum: examples a cell; checks: the rows whose checks the
    rubric must define, if other than the judge's.
    """
    one = judge.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(identity.content_hash(F.col("prompt"))).alias("prompts"))
    missing = missing_checks(judge if checks is None else checks, rubric).agg(F.count(F.lit(1)).alias("missing"))
    plan = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("subject", "behavior").alias("distinct_cells"), F.count_if(~F.col("minimum_examples").eqNullSafe(minimum)).alias("off"))
    held = stats.where(F.col("path") == judge_path).agg(F.count(F.lit(1)).alias("files"), F.max("prompts_hashed").alias("hashed"))
    kept = reservations.agg(F.count(F.lit(1)).alias("reservations"))
    row = one_row(one, missing, plan, held, kept)
    passed = {
        "unique_judge_ids": (F.col("n") == expected) & (F.col("ids") == expected),
        "unique_judge_prompts": F.col("prompts") == expected,
        "rubric_covers_checks": F.col("missing") == 0,
        "all_cells_once": (F.col("cells") == 20) & (F.col("distinct_cells") == 20),
        "cell_minimum": F.col("off") == 0,
        "judge_frozen": (F.col("files") == 1) & F.col("hashed").eqNullSafe(expected),
        "reservations_present": F.col("reservations") > 0,
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in passed.items()))
    return row.select(F.inline(rows))


def missing_checks(used: DataFrame, rubric: DataFrame, checks: str = "checks", name: str = "name") -> DataFrame:
    """(check): names used by some row that the rubric does not define."""
    return used.select(F.explode(checks).alias("check")).distinct().join(rubric.select(F.col(name).alias("check")), "check", "left_anti")


def verify_manifest(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) of recorded files (path, sha256, n_lines) against actual ones: same, changed or missing."""
    a = actual.select("path", F.col("sha256").alias("_sha"), F.col("n_lines").alias("_lines"))
    same = (F.col("sha256") == F.col("_sha")) & (F.col("n_lines") == F.col("_lines"))
    return recorded.join(a, "path", "left").select("path", F.when(F.col("_sha").isNull(), "missing").when(same, "same").otherwise("changed").alias("status"))
