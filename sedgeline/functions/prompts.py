"""Prompts, answers and roles out of records of several shapes.

Records come as one JSON string a row, since their shapes differ from file to file;
messages come as array<struct<role, content>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgeline import vocab

_MESSAGES = "array<struct<role:string,content:string>>"


def _text(record: Column, path: str) -> Column:
    """A JSON string at a path; null for other kinds of values."""
    value = F.try_parse_json(record)
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def _messages(record: Column) -> Column:
    return F.from_json(F.get_json_object(record, "$.messages"), _MESSAGES)


def user_contents(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: (m["role"] == "user") & m["content"].isNotNull()), lambda m: m["content"])


def first_user(messages: Column) -> Column:
    """The first user message; null without one."""
    return F.try_element_at(user_contents(messages), F.lit(1))


def prompt_v1(record: Column) -> Column:
    """All user messages; else an example's question with choices, or premise and
    hypothesis; else an English and Amharic pair; else the first text field that isn't blank."""
    users = user_contents(_messages(record))
    t = lambda path: _text(record, path)
    filled = lambda c: F.when(F.trim(c) != "", c)
    choices = F.get_json_object(record, "$.example.choices")
    question = filled(t("$.example.question"))
    with_choices = F.when(question.isNotNull() & choices.isNotNull() & ~choices.isin("", "[]", "{}", "null", "0", "false"), F.concat(question, F.lit("\n"), choices)).otherwise(question)
    pair = lambda a, b: F.concat(a, F.lit("\n"), b)
    return F.coalesce(
        F.when(F.size(users) > 0, F.array_join(users, "\n")),
        with_choices,
        pair(t("$.example.premise"), t("$.example.hypothesis")),
        pair(t("$.en"), t("$.am")),
        *(filled(t(f"$.{k}")) for k in ("prompt", "question", "text", "input")),
        F.coalesce(pair(filled(t("$.premise")), t("$.hypothesis")), filled(t("$.premise"))),
    )


def prompt_v0(record: Column) -> Column:
    """question; else the first user message; else the example's question, premise, prompt
    or text; else the record itself, keys sorted."""
    from sedgeline.functions.identity import stable_json

    t = lambda path: F.nullif(F.get_json_object(record, path), F.lit(""))
    first = F.nullif(first_user(_messages(record)), F.lit(""))
    return F.coalesce(t("$.question"), first, *(t(f"$.example.{k}") for k in ("question", "premise", "prompt", "text")), stable_json(record))


def gold_answer(answer: Column, raw: Column) -> Column:
    """The answer, else the first that isn't blank of a raw JSON object's answer_number, answer, target, label; else empty."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(answer), *(filled(F.get_json_object(raw, f"$.{k}")) for k in ("answer_number", "answer", "target", "label")), F.lit(""))


def prediction(pred: Column, assistant: Column) -> Column:
    return F.coalesce(F.nullif(pred, F.lit("")), F.nullif(assistant, F.lit("")), F.lit(""))


def role_order(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["role"]), ",")


def valid_role_order(messages: Column) -> Column:
    return F.coalesce(role_order(messages).isin(*vocab.MESSAGE_ORDERS), F.lit(False))


def render_chat(messages: Column) -> Column:
    """One ``ROLE: content`` line a message, and a line end."""
    return F.concat(F.array_join(F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n"), F.lit("\n"))


def distinct_items(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def same_keys(m: Column, names: Column) -> Column:
    """Whether a map has exactly these keys."""
    return F.array_sort(F.map_keys(m)) == F.array_sort(F.array_distinct(names))


def all_passed(results: Column) -> Column:
    """Whether every struct of a map has passed = true; true for an empty map."""
    return F.forall(F.map_values(results), lambda r: F.coalesce(r["passed"], F.lit(False)))


def sums_to(m: Column, total: float = 1.0, tolerance: float = 1e-6) -> Column:
    return F.abs(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x) - F.lit(total)) <= tolerance


def intent_allowed(move: Column, intent: Column) -> Column:
    table = F.create_map(*(x for k, v in vocab.MOVE_INTENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(F.try_element_at(table, move), intent), F.lit(False))
