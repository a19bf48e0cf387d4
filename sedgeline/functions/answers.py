"""Worked solutions and answers: extraction, rewriting and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgeline.functions import text

#: The final-answer mark and calculation spans of worked solutions.
FINAL = r"(?U)####\s*(-?\d+(?:\.\d+)?)"
SPAN = r"<<([^>=]+)=([^>]+)>>"
_VALUE = r"-?\d+(?:\.\d+)?"
# The English words of numbers.
UNITS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = ("hundred", "thousand", "million")
#: What ``clean_solution`` finds after an equals sign.
TIGHT_EQUALS, WIDE_EQUALS = r"=(\S)", r"=\s+"


def final_answer(c: Column) -> Column:
    """The number after the first mark, up to a thousands comma, if any; null without one."""
    return F.nullif(F.regexp_extract(c, FINAL, 1), F.lit(""))


def final_answer_with_commas(c: Column) -> Column:
    """As ``final_answer``, thousands commas read as parts of the number and left out."""
    return F.nullif(F.replace(F.regexp_extract(c, r"(?U)####\s*(-?\d+(?:,\d{3})*(?:\.\d+)?)", 1), F.lit(","), F.lit("")), F.lit(""))


def spans(c: Column) -> Column:
    """All calculation spans as array<struct<expr, val>>, trimmed."""
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(SPAN), F.lit(1)).alias("expr"), F.regexp_extract_all(c, F.lit(SPAN), F.lit(2)).alias("val"))
    return F.transform(both, lambda s: F.struct(F.trim(s["expr"]).alias("expr"), F.trim(s["val"]).alias("val")))


def clean_solution(c: Column, include_final: bool = True) -> Column:
    """A worked solution as numbered plain lines: spans written out, markup gone.

    A span whose value is repeated after it keeps it once, one followed by another number
    has that in brackets. Lines that already have a number keep it; others get their own
    place. Null counts as empty.
    """
    t = F.coalesce(c, F.lit(""))
    for pattern, to in (
        (rf"=\s*(\$?)<<[^>=]+=\s*({_VALUE})\s*>>\s*\2(?!\d|\.\d)", "= $1$2"),
        (rf"=\s*(\$?)<<[^>=]+=\s*([^>]*?)\s*>>\s*({_VALUE})", "= $1$2 ($3)"),
        (r"=\s*(\$?)<<[^>=]+=\s*([^>]*?)\s*>>", "= $1$2"),
        (r"<<\s*([^>=]+?)\s*=\s*([^>]*?)\s*>>", "$1 = $2"),
        (FINAL.removeprefix("(?U)"), ""),
        (TIGHT_EQUALS, "= $1"),
        (WIDE_EQUALS, "= "),
    ):
        t = F.regexp_replace(t, "(?U)" + pattern, to)
    numbered = F.transform(text.lines(t), lambda x, i: F.when(x.rlike(r"(?U)^\d+[.)]\s"), x).otherwise(F.concat((i + 1).cast("string"), F.lit(". "), x)))
    body = F.array_join(numbered, "\n")
    return F.when(final_answer(c).isNotNull(), F.concat(body, F.lit("\n\nFinal answer: "), final_answer(c))).otherwise(body) if include_final else body


def hint(question: Column, answer: Column, templates: dict[str, str] | None = None) -> Column:
    """A hint from the first span, else from the question's first two numbers, else a general one.

    templates: printf patterns ``span`` (expression, value), ``numbers`` (first, second), ``general``.
    """
    t = HINTS | (templates or {})
    first, n = F.try_element_at(spans(F.coalesce(answer, F.lit(""))), F.lit(1)), text.numbers(F.coalesce(question, F.lit("")))
    return (
        F.when(first.isNotNull(), F.format_string(t["span"], first["expr"], first["val"]))
        .when(F.size(n) >= 2, F.format_string(t["numbers"], F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))))
        .otherwise(F.lit(t["general"]))
    )


HINTS = {
    "span": "Begin with %s, which should come to about %s. What does that value stand for?",
    "numbers": "Combine %s and %s first. What does the result stand for?",
    "general": "Name the first operation before you compute. What is still unknown after it?",
}


def wrong_answer(gold: Column) -> Column:
    """A number beside the right one: one more, or one less than zero; written as an
    integer or as a float, as the right one is. Null for null."""
    whole = gold.try_cast("decimal(38,0)")
    part = gold.try_cast("double")
    return F.when(F.instr(gold, ".") > 0, F.when(part != 0, part + 1).otherwise(part - 1).cast("string")).otherwise(F.when(whole != 0, whole + 1).otherwise(whole - 1).cast("string"))


def diagnosis(question: Column, answer: Column) -> Column:
    """struct<user, assistant>: a student's wrong result and what led to it; null without a final answer."""
    wrong = wrong_answer(final_answer(answer))
    first = F.try_element_at(spans(answer), F.lit(1))
    why = F.when(first.isNotNull(), F.format_string("%s should give %s", first["expr"], first["val"])).otherwise(F.lit("an early step was miscounted"))
    user = F.concat(F.lit("A student answers "), wrong, F.lit(".\n\n"), question, F.lit("\n\nFind the first mistake without giving the answer."))
    return F.when(wrong.isNotNull(), F.struct(user.alias("user"), F.concat(F.lit("First mistake: "), why, F.lit(", so the result "), wrong, F.lit(" can't be right.")).alias("assistant")))


def normalize_answer(c: Column) -> Column:
    """After the last ``</think>``: the last number without thousands commas, else the last word, else empty."""
    t = F.replace(F.lower(F.substring_index(F.coalesce(c, F.lit("")), "</think>", -1)), F.lit(","), F.lit(""))
    numbers = F.regexp_extract_all(t, F.lit(f"(?U)({_VALUE})"), F.lit(1))
    words = F.filter(F.split(t, rf"(?U){text.SPACE}+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit(""))


def choice_letter(pred: Column) -> Column:
    """The first character of a prediction, trimmed and in upper case; empty for none."""
    return F.left(F.upper(F.trim(F.coalesce(pred, F.lit("")))), F.lit(1))


def gold_letter(gold: Column) -> Column:
    """A letter, or the letter of a place below 4."""
    g = F.upper(F.trim(F.coalesce(gold, F.lit(""))))
    place = F.try_element_at(F.array(*map(F.lit, "ABCD")), F.when(g.rlike(r"^\d{1,9}$"), g.cast("int") + 1))
    return F.left(F.coalesce(place, g), F.lit(1))


def number_words(n: Column) -> Column:
    """The English words of a whole number from 0 to 999,999,999, with single spaces and without "and"
    (two hundred five); null for others."""
    n = F.when((n >= 0) & (n < 1_000_000_000) & (n == F.floor(n)), n.cast("long"))
    unit = lambda k: F.element_at(F.array(*map(F.lit, UNITS)), (k + 1).cast("int"))
    ten = lambda k: F.element_at(F.array(*map(F.lit, TENS)), F.greatest(F.lit(1), k - 1).cast("int"))

    def below_hundred(k):
        return F.when(k < 20, unit(F.least(k, F.lit(19)))).otherwise(F.concat_ws(" ", ten(F.floor(k / 10)), F.when(k % 10 > 0, unit(k % 10))))

    def below_thousand(k):
        return F.concat_ws(" ", F.when(k >= 100, F.concat(unit(F.floor(k / 100)), F.lit(" hundred"))), F.when((k % 100 > 0) | (k == 0), below_hundred(k % 100)))

    million, thousand, rest = F.floor(n / 1_000_000), F.floor(n / 1000) % 1000, n % 1000
    parts = [F.when(million > 0, F.concat(below_thousand(million), F.lit(" million"))), F.when(thousand > 0, F.concat(below_thousand(thousand), F.lit(" thousand"))), F.when((rest > 0) | (n == 0), below_thousand(rest))]
    return F.when(n.isNotNull(), F.concat_ws(" ", *parts))


def _as_words(t: Column, value: Column) -> Column:
    """Whether a lower-case text holds a number's words that are no part of a longer number's; "and" may
    stand after hundred, thousand and million, hyphens for spaces."""
    scale, units, tens = "|".join(SCALES), "|".join(UNITS[1:]), "|".join(TENS)
    spaced = F.trim(F.regexp_replace(t, r"(?U)\W+", " "))
    inner = F.regexp_replace(number_words(value), rf"\b({scale}) ", "$1 (?:and )?")
    before = rf"(?<!\b(?:{scale}|{tens}) )(?<!\b(?:{scale}) and )\b"
    after = rf"\b(?! (?:{scale})\b|(?<=ty) (?:{'|'.join(UNITS[1:10])})\b|(?<={scale})(?: and)? (?:{units}|{tens})\b)"
    return F.coalesce(F.regexp_like(spaced, F.concat(F.lit(before), inner, F.lit(after))), F.lit(False))


def mentions_number(c: Column, value: Column) -> Column:
    """Whether a text states a number's value: as digits (9, 9.0, 1,234), a fraction (18/2) or in English
    words (twenty-one, two hundred and five); digits inside a longer number don't count, nor do words
    inside a longer number's. Full-width digits count, digits of other scripts don't."""
    t = F.regexp_replace(F.lower(text.nfkc(c)), r"(?<=\d),(?=\d{3}(?!\d))", "")
    v = value.try_cast("double")
    plain = F.regexp_extract_all(t, F.lit(r"(?U)(?<![\w./])(-?\d+(?:\.\d+)?)(?![\w/]|\.\d)"), F.lit(1))
    above = F.regexp_extract_all(t, F.lit(r"(?U)(?<![\w.])(-?\d+)\s*/\s*\d+(?![\w]|\.\d)"), F.lit(1))
    below = F.regexp_extract_all(t, F.lit(r"(?U)(?<![\w.])-?\d+\s*/\s*(\d+)(?![\w]|\.\d)"), F.lit(1))
    fraction = F.exists(F.arrays_zip(above.alias("a"), below.alias("b")), lambda x: (x["b"].try_cast("double") != 0) & (x["a"].try_cast("double") == v * x["b"].try_cast("double")))
    hit = F.exists(plain, lambda x: F.coalesce(x.try_cast("double") == v, F.lit(False)))
    return hit | F.coalesce(fraction, F.lit(False)) | _as_words(t, v)
