"""Writing tables and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, nulls kept, overwriting."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(report: DataFrame, path: str, rows: int = 100_000) -> None:
    """A small table as an indented JSON list; more than ``rows`` rows are an error."""
    got = report.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report of more than {rows} rows")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in got], ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def markdown(report: DataFrame, *order: str, rows: int = 10_000) -> str:
    """A small table as a Markdown table, sorted; more than ``rows`` rows are an error."""
    got = report.orderBy(*order).limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report of more than {rows} rows")
    cells = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([cells(report.columns), cells("---" for _ in report.columns), *map(cells, got)]) + "\n"


def filter_on_write(df: DataFrame, keep: Column, path: str) -> dict[str, int]:
    """Write the rows that meet a condition and count both sides, in one job; null doesn't meet it."""
    sides, kept = Observation("sides"), F.coalesce(keep, F.lit(False))
    counted = df.withColumn("_kept", kept).observe(sides, F.count_if("_kept").alias("kept"), F.count_if(~F.col("_kept")).alias("dropped"))
    counted.where("_kept").drop("_kept").write.mode("overwrite").parquet(path)
    return {"kept": sides.get["kept"], "dropped": sides.get["dropped"]}


def write_by_license(df: DataFrame, path: str, profile: str = "export_profile") -> None:
    """One folder a profile."""
    df.write.mode("overwrite").partitionBy(profile).parquet(path)


def json_schema(df: DataFrame, name: str, identifier: str, rules: Iterable = ()) -> dict:
    """The JSON Schema of a table's rows; rules: validation rules whose ``schema`` keywords (enum, bounds,
    pattern, lengths) are put at their location, and whose kind ``missing`` makes a field required."""

    def form(t) -> dict:
        kind = t.typeName()
        if kind == "struct":
            return {"type": "object", "properties": {f.name: form(f.dataType) for f in t.fields}, "required": [f.name for f in t.fields if not f.nullable], "additionalProperties": False}
        if kind == "array":
            return {"type": "array", "items": form(t.elementType)}
        if kind == "map":
            return {"type": "object", "additionalProperties": form(t.valueType)}
        names = {"string": "string", "boolean": "boolean", "double": "number", "float": "number"}
        return {"type": names.get(kind, "integer" if kind in ("long", "integer", "short", "byte") else "string")}

    whole = {"$id": identifier, "title": name, **form(df.schema)}
    for r in rules:
        *path, last = r.location.split(".") if r.location else [""]
        at = whole
        for p in path:
            at = at.get("properties", {}).get(p, {})
        if last in at.get("properties", {}):
            if r.kind == "missing":
                at["required"] = sorted({*at.get("required", []), last})
            else:
                at["properties"][last] |= r.schema or {}
    return whole
