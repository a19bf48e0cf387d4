"""The catalogue's registry of queries, and SQL fragments their twins share."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedgeline.functions import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
#: A character of a word, as Unicode-aware patterns see it.
WORD = r"\pL\pN\pM\p{Pc}"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm0(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{SPACE}+', ' ', 'g'))"


def nfkc(c: str) -> str:
    """NFKC as far as DuckDB can: compatibility characters of the blocks below are mapped one to one, or
    replaced by their several characters, then the whole is composed."""
    one, other = {}, {}
    for low, high in ((0xA0, 0x100), (0x1D2C, 0x1D6B), (0x2000, 0x2190), (0x2460, 0x24FF), (0x3000, 0x3001), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)):
        for ch in map(chr, range(low, high)):
            form = unicodedata.normalize("NFKC", ch)
            if form != ch:
                (one if len(form) == 1 else other)[ch] = form
    for low, high in ((0x3380, 0x33E0), (0xFB00, 0xFB07)):
        other |= {ch: unicodedata.normalize("NFKC", ch) for ch in map(chr, range(low, high))}
    x = f"translate({c}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    for ch, form in other.items():
        if ch.isprintable() and ch not in "¨¯´¸":  # spacing accents fold into a space and a mark
            x = f"replace({x}, {quoted(ch)}, {quoted(form)})"
    return f"nfc_normalize({x})"


def folded(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def _norm1_folded(c: str) -> str:
    x = f"translate({c}, '−×÷', '-*/')"
    for _ in range(2):  # of neighbouring commas each pass takes every other one
        x = rf"regexp_replace({x}, '(\p{{Nd}}),(\p{{Nd}}{{3}})($|[^{WORD}])', '\1\2\3', 'g')"
    x = rf"regexp_replace({x}, '{SPACE}*([,.;:!?=+\-*/^(){{}}\[\]]){SPACE}*', '\1', 'g')"
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def norm1(c: str) -> str:
    return _norm1_folded(folded(nfkc(c)))


def template(c: str) -> str:
    x = nfkc(c)
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^{WORD}])([A-Z][a-z]{{2,}})($|[^{WORD}])', '\1<name>\3', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^{WORD}.])[-+]?(?:\p{{Nd}}+(?:,\p{{Nd}}{{3}})*(?:\.\p{{Nd}}+)?|\.\p{{Nd}}+)(?:[eE][-+]?\p{{Nd}}+)?($|[^{WORD}.])', '\1ǃ\2', 'g')"  # a letter, as a sign after a number is none
    return _norm1_folded(folded(f"replace({x}, 'ǃ', '<number>')"))


def sha(ns: str, *parts: str) -> str:
    return f"'sha256:' || sha256('{ns}' || chr(31) || 'norm-v1' || chr(31) || " + " || chr(31) || ".join(parts) + ")"


def split_name(c: str) -> str:
    s = rf"regexp_replace(regexp_replace(lower({c}), '^{SPACE}+|{SPACE}+$', '', 'g'), '[\s\p{{Z}}_-]+', '_', 'g')"
    names = {"train": text.TRAIN_SPLITS, "validation": text.VALIDATION_SPLITS, "test": text.TEST_SPLITS, "external_eval": (*text.EXTERNAL_SPLITS, *text.OTHER_EVAL_SPLITS)}
    return f"CASE {' '.join('WHEN {} IN ({}) THEN {}'.format(s, ', '.join(map(quoted, v)), quoted(k)) for k, v in names.items())} END"


#: Rows (exact, template): hashes of the evaluation's prompts, of the inventory's evaluation splits and the items.
FROZEN = f"""
prompts_ AS (SELECT canonical_prompt AS p FROM inventory WHERE {split_name('source_split')} <> 'train' UNION ALL SELECT text FROM eval_items),
frozen_ AS (SELECT {sha('canonical-content', norm1('p'))} AS exact, {sha('template', template('p'))} AS template FROM prompts_ WHERE length(p) > 0),
hashed_ AS (SELECT record_no, {sha('canonical-content', norm1('canonical_prompt'))} AS h, {sha('template', template('canonical_prompt'))} AS t FROM inventory),
firewall_ AS (SELECT record_no, coalesce(h IN (SELECT exact FROM frozen_), false) AS exact_match, coalesce(t IN (SELECT template FROM frozen_), false) AS template_match FROM hashed_)"""
