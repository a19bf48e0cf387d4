"""Instruction mixes: rows with two messages from worked solutions, science questions and authored text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions import answers, text
from sedgeline.operators import firewall, ordinal

#: Wording of the rows; own defaults, to be replaced as needed. %s is the question.
WORDING = {
    "solve": "Solve this step by step.\n\n%s",
    "explain": "Explain each step of the solution to a pupil.\n\n%s",
    "hint": "Give one hint and one check question, not the answer.\n\n%s",
    "science_solve": "Answer this question.\n\n%s",
    "science_explain": "Answer and explain this to a pupil.\n\n%s",
    "science_hint": "Give one hint for this question, not the answer.\n\n%s",
}


def chat_row(id_: Column, behavior: Column, user: Column, assistant: Column, source: str, direction: str = "en_en") -> list[Column]:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return [id_.alias("id"), F.lit(direction).alias("direction"), behavior.alias("behavior"), F.array(message("user", user), message("assistant", assistant)).alias("messages"), F.lit(source).alias("source")]


def from_solutions(df: DataFrame, limit: int | None = None, name: str = "worked", wording: dict[str, str] | None = None) -> DataFrame:
    """Rows of (ordinal, question, answer): solve, explain, hint and first_error in turn.

    A first_error whose answer has no final number becomes solve.
    """
    w = WORDING | (wording or {})
    rows = df if limit is None else df.where(F.col("ordinal") < limit)
    turn = ordinal.assign_cycle(rows, ["solve", "explain", "hint", "first_error"], "_turn")
    q, a = F.col("question"), F.col("answer")
    pair = answers.diagnosis(q, a)
    behavior = F.when((F.col("_turn") == "first_error") & pair.isNull(), "solve").otherwise(F.col("_turn"))
    plain, say = answers.clean_solution(a), lambda k: F.format_string(w[k], q)
    user = F.when(behavior == "explain", say("explain")).when(behavior == "hint", say("hint")).when(behavior == "first_error", pair["user"]).otherwise(say("solve"))
    assistant = F.when(behavior == "hint", answers.hint(q, a)).when(behavior == "first_error", pair["assistant"]).otherwise(plain)
    return turn.select(*chat_row(ordinal.ordinal_id(F.concat(F.lit("en_en_"), behavior, F.lit(f"_{name}"))), behavior, user, assistant, f"{name}_train"))


def from_science(df: DataFrame, limit: int | None = None, ways: int = 3, name: str = "science", wording: dict[str, str] | None = None, strip: bool = True) -> DataFrame:
    """Rows of (ordinal, question, correct_answer, support): solve, explain (and hint, of three ways) by the
    ordinal. Rows with an empty answer are dropped but counted; the limit is of kept rows."""
    w = WORDING | (wording or {})
    a = F.coalesce("correct_answer", F.lit(""))
    a = F.trim(a) if strip else a
    kept = ordinal.kept_limit(df, a != "", limit)
    turn = ordinal.assign_cycle(kept, ["solve", "explain", "hint"][:ways], "_turn")
    support = F.trim(F.coalesce("support", F.lit("")))
    body = F.when(support != "", support).otherwise(F.concat(F.lit("The answer is "), a, F.lit(".")))
    b = F.col("_turn")
    user = F.when(b == "explain", F.format_string(w["science_explain"], "question")).when(b == "hint", F.format_string(w["science_hint"], "question")).otherwise(F.format_string(w["science_solve"], "question"))
    assistant = F.when(b == "hint", F.lit("Underline what the question asks for. Is it a name, a cause or a comparison?")).otherwise(F.concat(a, F.lit("\n\nExplanation: "), body))
    return turn.select(*chat_row(ordinal.ordinal_id(F.concat(F.lit("en_en_"), b, F.lit(f"_{name}"))), b, user, assistant, f"{name}_train"))


def with_variants(df: DataFrame, checklist: tuple[str, ...] = ("explain", "hint", "first_error")) -> DataFrame:
    """Every row, a concise variant of it, and for some behaviors one with a checklist; ids get a suffix."""
    wanted = F.array_compact(F.array(F.lit("base"), F.lit("concise"), F.when(F.col("behavior").isin(*checklist), "checklist")))
    ask = F.create_map(F.lit("base"), F.lit(""), F.lit("concise"), F.lit("\n\nBe concise."), F.lit("checklist"), F.lit("\n\nGo through a checklist."))
    each = df.withColumn("variant", F.explode(wanted))
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.concat(m["content"], ask[F.col("variant")])).otherwise(m["content"]).alias("content")))
    return each.withColumn("messages", messages).withColumn("id", F.when(F.col("variant") == "base", F.col("id")).otherwise(F.concat_ws("_", "id", "variant")))


def from_templates(spark, rows: list[tuple], columns: list[str], pattern: str, fill: list[str], behavior: str, source: str = "authored") -> DataFrame:
    """Rows from a template and a table of what fills it, numbered within the behavior."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["ordinal", *columns])
    return df.select(*chat_row(ordinal.ordinal_id(F.concat_ws("_", F.lit(source), F.lit(behavior))), F.lit(behavior), F.format_string(pattern, *fill), F.col("assistant"), source))


def union(*parts: DataFrame) -> DataFrame:
    """Parts one after the other; ``part`` holds the order."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def leaks(df: DataFrame) -> DataFrame:
    """(id): rows with source markup in an assistant message."""
    return df.where(F.exists("messages", lambda m: (m["role"] == "assistant") & text.has_markup(m["content"]))).select("id")


def assert_no_markup(df: DataFrame) -> None:
    bad = [r.id for r in leaks(df).orderBy("id").limit(5).collect()]
    if bad:
        raise ValueError(f"markup leak, among others in {bad}")


def without_evaluation(df: DataFrame, frozen: DataFrame, frozen_text: str = "text", skip: bool = False) -> DataFrame:
    """The rows whose first user message isn't a frozen prompt."""
    first = F.try_element_at(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), F.lit(1))
    return firewall.survivors_v0(df.withColumn("_first", first), frozen, "_first", frozen_text, skip).drop("_first")


def counts(df: DataFrame, *by: str) -> DataFrame:
    """(grouping, value, row_count): all rows, and rows by each column, in one pass."""
    listed = [c for c in by]
    sets = df.groupingSets([[], *([c] for c in listed)], *listed).agg(F.count(F.lit(1)).alias("row_count"), F.grouping_id().alias("_g"))
    name = F.lit("all")
    value = F.lit(None).cast("string")
    for i, c in enumerate(listed):
        bit = (1 << len(listed)) - 1 - (1 << (len(listed) - 1 - i))
        name = F.when(F.col("_g") == bit, c).otherwise(name)
        value = F.when(F.col("_g") == bit, F.col(c)).otherwise(value)
    return sets.select(name.alias("grouping_name"), value.alias("grouping_value"), "row_count")


def enough(df: DataFrame, minimum: int = 5000) -> DataFrame:
    """One row: whether a mix has the least rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("passed", F.col("row_count") >= minimum)
