"""Stable identifiers: namespaced SHA-256 over parts joined by U+001F."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from sedgeline import vocab
from sedgeline.functions import text


def hash_v0(c: Column) -> Column:
    """Bare hexadecimal SHA-256 of ``norm_v0``."""
    return F.sha2(text.norm_v0(c), 256)


def sha256_id(*parts: Column, namespace: str) -> Column:
    """``sha256:`` and the digest of namespace, normalization version and parts.

    Null in any part gives null: a part that silently vanished would give another
    record's identifier.
    """
    joined = F.concat(F.lit(f"{namespace}\u001f{vocab.NORMALIZATION}"), *(x for p in parts for x in (F.lit("\u001f"), p)))
    return F.concat(F.lit("sha256:"), F.sha2(joined, 256))


def content_hash(c: Column) -> Column:
    return sha256_id(text.norm_v1(c), namespace="canonical-content")


def message_hash(content: Column, role: Column) -> Column:
    return sha256_id(role, text.norm_v1(content), namespace="message")


def template_fingerprint(c: Column) -> Column:
    return sha256_id(text.template_norm(c), namespace="template")


def source_key(dataset: Column, revision: Column, split: Column, original_id: Column) -> Column:
    """dataset@revision/split/original_id; null if any part is."""
    return F.concat(dataset, F.lit("@"), revision, F.lit("/"), split, F.lit("/"), original_id)


def source_family(key: Column) -> Column:
    return sha256_id(key, namespace="source-family")


def generator_family(template_version: Column, surface_context: Column) -> Column:
    return sha256_id(template_version, surface_context, namespace="generator-family")


def family_id(key: Column, template_version: Column, surface_context: Column) -> Column:
    """A family from a source key or from template and context; anything else is an error.
    Empty strings count as absent."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    source, both, any_ = has(key), has(template_version) & has(surface_context), has(template_version) | has(surface_context)
    return (
        F.when(source & ~any_, source_family(key))
        .when(~source & both, generator_family(template_version, surface_context))
        .otherwise(F.raise_error(F.lit("give a source key, or a template version and a surface context")))
    )


def row_id(family: Column, behavior: Column, signature: Column, renderer: Column) -> Column:
    return sha256_id(family, behavior, signature, renderer, namespace="training-row")


@pandas_udf(StringType())
def _stable_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def stable_json(c: Column) -> Column:
    """JSON text with sorted keys and no spaces, numbers as Python writes them."""
    return _stable_json(c)


@pandas_udf(StringType())
def _signed_items(s: pd.Series) -> pd.Series:
    def form(x):
        if x is None:
            return None
        items = [{"id": i["id"] if isinstance(i["id"], str) else str(i["id"]), "parameters": i.get("parameters", {})} for i in json.loads(x)]
        return json.dumps(sorted(items, key=lambda i: i["id"]), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return s.map(form)


def constraint_signature(items_json: Column) -> Column:
    """The signature of constraints given as a JSON array: ids and parameters (none: ``{}``), sorted by id."""
    return sha256_id(_signed_items(items_json), namespace="constraints")


def constraint_signature_flat(items: Column) -> Column:
    """As ``constraint_signature``, for array<struct<id, parameters map<string,string>>> with
    string parameters, without Python: keys are sorted by Spark and null maps count as empty."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    body = lambda m: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))), lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))
    each = F.transform(F.array_sort(items, lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)), lambda i: F.concat(F.lit('{"id":'), quoted(i["id"]), F.lit(',"parameters":'), body(i["parameters"]), F.lit("}")))
    return sha256_id(F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")), namespace="constraints")
