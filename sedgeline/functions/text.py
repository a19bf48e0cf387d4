"""Text normalization, scanning and previews: Column -> Column, null in, null out
unless said otherwise. Patterns carry ``(?U)``, so that classes mean Unicode classes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SPACE = r"[\s\x1c-\x1f]"
NUMBER = r"\d+(?:\.\d+)?"
#: Fixed value: a number as templates mask it.
TEMPLATE_NUMBER = r"(?U)(?<![\w.])[-+]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?(?![\w.])"
#: Source markup, and artifacts that must not reach records.
MARKUP = r"####|<<[^>]*>>"
ARTIFACT = r"(?i)(<think>|</think>|####|<<[^>]*>>|<\|(?:assistant|user|system)\|>)"
#: What ends a line for splitting into lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@pandas_udf(StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def _beyond_ascii(c: Column, udf, ascii_form: Column) -> Column:
    """The UDF for texts with other than ASCII characters; only these travel to Python."""
    plain = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.coalesce(udf(F.when(~plain, c)), F.when(plain, ascii_form))


def nfkc(c: Column) -> Column:
    """Compatibility composition (NFKC)."""
    return _beyond_ascii(c, _nfkc, c)


def casefold(c: Column) -> Column:
    """Full case folding (``ß`` becomes ``ss``)."""
    return _beyond_ascii(c, _casefold, F.lower(c))


def norm_v0(c: Column) -> Column:
    """Lower case, trimmed, runs of spaces as one space."""
    return F.trim(F.regexp_replace(F.lower(c), rf"(?U){SPACE}+", " "))


#: A comma between thousands, punctuation with the space around it, and a name as templates mask it.
THOUSANDS = r"(?U)(?<=\d),(?=\d{3}\b)"
TIGHT = rf"(?U){SPACE}*([,.;:!?=+\-*/^(){{}}\[\]]){SPACE}*"
TEMPLATE_NAME = r"(?U)\b[A-Z][a-z]{2,}\b"


def _norm_v1_folded(c: Column) -> Column:
    signs = F.replace(F.replace(F.replace(c, F.lit("−"), F.lit("-")), F.lit("×"), F.lit("*")), F.lit("÷"), F.lit("/"))
    thousands = F.regexp_replace(signs, THOUSANDS, "")
    tight = F.regexp_replace(thousands, TIGHT, "$1")
    return F.trim(F.regexp_replace(tight, rf"(?U){SPACE}+", " "))


def norm_v1(c: Column) -> Column:
    """NFKC, one form of minus, times and division, no thousands commas, no space around
    punctuation, single spaces, case folded. Folding goes first: it changes letters only,
    and the other steps never look at case."""
    return _norm_v1_folded(_beyond_ascii(c, _nfkc_casefold, F.lower(c)))


def template_norm(c: Column) -> Column:
    """``norm_v1`` after capitalized words became ``<name>`` and numbers ``<number>``."""
    names = F.regexp_replace(nfkc(c), TEMPLATE_NAME, "<name>")
    return _norm_v1_folded(casefold(F.regexp_replace(names, TEMPLATE_NUMBER, "<number>")))


#: Normal forms by version.
NORMALIZERS = {"norm-v0": norm_v0, "norm-v1": norm_v1, "template-v1": template_norm}


def normalize(c: Column, version: str) -> Column:
    """A normal form by its version's name; an unknown one is an error."""
    if version not in NORMALIZERS:
        raise ValueError(f"unknown normalization {version!r}; known: {', '.join(NORMALIZERS)}")
    return NORMALIZERS[version](c)


def normalize_by(c: Column, version: Column) -> Column:
    """As ``normalize``, the version being a column; rows with an unknown one fail, with a null one are null."""
    out = F.when(version.isNotNull(), F.raise_error(F.concat(F.lit("unknown normalization "), version)).cast("string"))
    for name, f in NORMALIZERS.items():
        out = F.when(version == name, f(c)).otherwise(out)
    return out


def find_artifact(c: Column) -> Column:
    """The first banned source artifact, as written; null without one."""
    return F.nullif(F.regexp_extract(c, ARTIFACT, 1), F.lit(""))


def has_markup(c: Column) -> Column:
    return c.rlike(MARKUP)


def numbers(c: Column) -> Column:
    """All unsigned numbers, in order."""
    return F.regexp_extract_all(c, F.lit(f"(?U)({NUMBER})"), F.lit(1))


def question_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\?"))


def preview(c: Column, length: int = 240) -> Column:
    """The first characters; null as empty."""
    return F.left(F.coalesce(c, F.lit("")), F.lit(length))


def tail(c: Column, length: int = 4000) -> Column:
    """The last characters, as kept of a traceback."""
    return F.right(c, F.lit(length))


def strip_think(c: Column) -> Column:
    """What follows the last ``</think>``, trimmed."""
    return F.trim(F.substring_index(c, "</think>", -1))


def lines(c: Column) -> Column:
    """The lines of a text, at every line end that Unicode knows, trimmed and without blank ones."""
    trimmed = F.transform(F.split(c, LINE_END), lambda x: F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def script_share(c: Column, script: str = "Ethiopic") -> Column:
    """The part of a text's letters that belong to a script; 0 without letters."""
    letters = F.length(F.regexp_replace(c, r"(?U)[^\p{L}]", ""))
    own = F.regexp_count(c, F.lit(rf"[\p{{L}}&&[\p{{Is{script}}}]]"))
    return F.when(letters > 0, own / letters).otherwise(F.when(c.isNotNull(), F.lit(0.0)))


def word_count(c: Column) -> Column:
    """Runs of characters other than spaces."""
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


#: Characters around a placeholder's number; private ones, so that no text holds them.
OPEN, CLOSE = "", ""


def protect(c: Column) -> tuple[Column, Column]:
    """(text with numbered placeholders for markup, the markup in order)."""
    spans = F.regexp_extract_all(c, F.lit(f"({MARKUP})"), F.lit(1))
    parts = F.split(c, MARKUP, -1)
    marked = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), x)))
    return F.array_join(marked, ""), spans


def restore(c: Column, spans: Column) -> Column:
    """The text with its placeholders replaced by the markup again."""
    pairs = F.transform(spans, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    return F.aggregate(pairs, c, lambda t, p: F.replace(t, F.concat(F.lit(OPEN), p["i"].cast("string"), F.lit(CLOSE)), p["s"]))


# Spellings of splits, after case folding and with separators as "_".
TRAIN_SPLITS = ("train", "training", "trn", "tr")
VALIDATION_SPLITS = ("validation", "valid", "val", "dev", "development")
TEST_SPLITS = ("test", "testing", "tst")
EXTERNAL_SPLITS = ("external_eval", "eval_external", "external", "external_evaluation", "evaluation_external", "ext_eval")
OTHER_EVAL_SPLITS = ("eval", "evaluation", "holdout", "held_out", "heldout")


def spelled(c: Column) -> Column:
    """Lower case, trimmed, with runs of spaces, ``-`` and ``_`` as one ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)[\s\-_]+", "_")


def split_name(c: Column) -> Column:
    """train, validation, test or external_eval; null for what names no split."""
    s = spelled(c)
    return (
        F.when(s.isin(*TRAIN_SPLITS), "train")
        .when(s.isin(*VALIDATION_SPLITS), "validation")
        .when(s.isin(*TEST_SPLITS), "test")
        .when(s.isin(*EXTERNAL_SPLITS, *OTHER_EVAL_SPLITS), "external_eval")
    )
