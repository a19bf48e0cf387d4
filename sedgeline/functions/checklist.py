"""Named checks of an answer, as predicates; unknown names are never met."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgeline.functions import text

# What a text must hold. Words of "any" and each of "all" are sought in lower case.
ANY = {
    "has_why": ("why", "because", "valid", "so that"),
    "names_mistake": ("mistake", "wrong", "error", "line"),
    "has_hint": ("hint", "recompute", "rewrite", "divide"),
    "mentions_turbine": ("turbine",),
    "mentions_energy": ("energy",),
    "mentions_force_or_power": ("force", "power"),
    "has_analogy": ("analogy", "like ", "think of", "similar"),
    "has_misconception": ("misconception", "common mistake", "people think"),
    "limiting_oxygen": ("oxygen", "o2"),
    "line1_or_distribute": ("line 1", "distribut"),
}
ALL_OF_ANY = {
    "velocity_zero": (("velocity",), ("zero",)),
    "accel_nonzero": (("acceleration",), ("not zero", "nonzero", "non-zero", "still", "gravity")),
    "completing_square": (("complet",), ("square",)),
    "has_final_formula": (("2a",), ("b^2", "b²", "discriminant")),
}
ABSENT_PATTERN = {"no_final_x": r"(?U)\bx\s*=\s*-?\d", "no_final_a": r"(?U)\ba\s*=\s*-?\d"}
PATTERN = {"co2_33": r"(?U)\b33\b"}
DEFAULT = ("no_markup",)


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def _all(low: Column, groups) -> Column:
    out = _any(low, groups[0])
    for g in groups[1:]:
        out = out & _any(low, g)
    return out


CHECKS: dict[str, Callable[[Column], Column]] = {
    "no_markup": lambda t: ~text.has_markup(t),
    "has_question": lambda t: t.contains("?"),
    "has_two_questions": lambda t: text.question_count(t) >= 2,
    **{n: (lambda t, w=w: _any(F.lower(t), w)) for n, w in ANY.items()},
    **{n: (lambda t, g=g: _all(F.lower(t), g)) for n, g in ALL_OF_ANY.items()},
    **{n: (lambda t, p=p: ~F.lower(t).rlike(p)) for n, p in ABSENT_PATTERN.items()},
    **{n: (lambda t, p=p: t.rlike(p)) for n, p in PATTERN.items()},
}


def register(name: str, check: Callable[[Column], Column]) -> None:
    """Make a further check known."""
    CHECKS[name] = check


def check(name: str, c: Column) -> Column:
    """One check of a text, null as empty."""
    t = F.coalesce(c, F.lit(""))
    return CHECKS[name](t) if name in CHECKS else F.lit(False)


def check_named(name: Column, c: Column) -> Column:
    """As ``check``, the name being a column."""
    t = F.coalesce(c, F.lit(""))
    out = F.lit(False)
    for n, f in CHECKS.items():
        out = F.when(name == n, f(t)).otherwise(out)
    return out
