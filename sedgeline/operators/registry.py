"""Uniqueness registry: keys, references and checks over tables without constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline import vocab


@dataclass(frozen=True)
class Unique:
    name: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    name: str
    table: str
    column: str
    target: str
    key: str


@dataclass(frozen=True)
class Check:
    name: str
    table: str
    broken: str


def _present(table: str, *columns: str) -> tuple[Check, ...]:
    return tuple(Check(f"{table}_{c}_present", table, f"{c} is null") for c in columns)


#: The registry's constraints. A null in a unique key is never equal to another; null references refer to
#: nothing; that keys and most other columns are there is checked column by column.
CONSTRAINTS = (
    Unique("source_records_key", "source_records", ("source_key",)),
    Unique("training_rows_key", "training_rows", ("row_id",)),
    Unique("training_rows_variant", "training_rows", ("family_id", "selected_behavior", "constraint_signature", "renderer_version")),
    Unique("build_membership_key", "build_membership", ("build_name", "row_id", "membership")),
    Reference("training_rows_source", "training_rows", "source_key", "source_records", "source_key"),
    Reference("training_rows_duplicate", "training_rows", "duplicate_of", "training_rows", "row_id"),
    Reference("build_membership_row", "build_membership", "row_id", "training_rows", "row_id"),
    Check("build_membership_value", "build_membership", "membership not in ({})".format(", ".join(f"'{m}'" for m in vocab.MEMBERSHIPS))),
    Check("build_membership_exposure", "build_membership", "exposure_count < 0"),
    *_present("source_records", "source_key", "dataset", "revision", "source_split", "original_id", "status", "created_at"),
    *_present("training_rows", "row_id", "family_id", "source_key", "selected_behavior", "constraint_signature", "renderer_version", "canonical_content_hash", "template_fingerprint", "status", "created_at"),
    *_present("build_membership", "build_name", "row_id", "membership", "exposure_count", "added_at"),
)
TABLES = ("source_records", "training_rows", "build_membership")


def violations(tables: dict[str, DataFrame], constraints=CONSTRAINTS) -> DataFrame:
    """(constraint_name, violations): rows beyond the first of a key, dangling references, broken checks.

    Keys are grouped with partial aggregation; references are anti joins against
    distinct keys, from distinct values, so a value that many rows share travels once. All
    checks of a table are one aggregate. A column that a table lacks is null in it.
    """
    parts = []
    for name, df in tables.items():
        of = [c for c in constraints if isinstance(c, Check) and c.table == name]
        if of:
            full = df.withColumns({c.name.removeprefix(f"{name}_").removesuffix("_present"): F.lit(None) for c in of if c.name.endswith("_present") and c.broken.removesuffix(" is null") not in df.columns})
            n = full.agg(*(F.count_if(F.coalesce(F.expr(c.broken), F.lit(False))).alias(c.name) for c in of))
            parts.append(n.select(F.inline(F.array(*(F.struct(F.lit(c.name).alias("constraint_name"), F.col(c.name).alias("violations")) for c in of)))))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    for c in constraints:
        if isinstance(c, Check):
            continue
        df = tables[c.table]
        if isinstance(c, Unique):
            n = df.dropna(subset=list(c.columns)).groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        else:
            used = df.where(F.col(c.column).isNotNull()).groupBy(F.col(c.column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            keys = tables[c.target].select(F.col(c.key).alias("k")).distinct()
            n = used.join(keys, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        one = n.select(F.lit(c.name).alias("constraint_name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def with_defaults(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """Nulls of a batch filled in: status, exposure count, time of insertion."""
    stamp = F.current_timestamp() if now is None else now
    fill = {"source_records": {"status": F.lit("candidate"), "created_at": stamp}, "training_rows": {"created_at": stamp}, "build_membership": {"exposure_count": F.lit(0), "added_at": stamp}}[table]
    return df.withColumns({k: F.coalesce(k, v) if k in df.columns else v for k, v in fill.items()})


def _folder(spark, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


#: The empty file by which a batch becomes part of the registry.
_DONE = "COMPLETE"


def batches(spark, root: str) -> list[str]:
    """The folders of the batches that were wholly written, oldest first."""
    fs, at, path = _folder(spark, root)
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [p for p in found if p.getName().startswith("b") and p.getName()[1:].isdigit() and fs.exists(path(p, _DONE))]
    return [str(p.toString()) for p in sorted(done, key=lambda p: int(p.getName()[1:]))]


def read(spark, root: str, name: str) -> DataFrame | None:
    """A table of the registry: its rows of all complete batches; None before the first. Damaged files fail."""
    out = None
    for folder in batches(spark, root):
        fs, at, _ = _folder(spark, f"{folder}/{name}")
        if fs.exists(at):
            part = spark.read.parquet(f"{folder}/{name}")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def append(spark, root: str, new: dict[str, DataFrame]) -> dict[str, int]:
    """Add rows to the registry's tables below a folder, all or nothing.

    The whole batch is checked against what is there; any violation of it raises and nothing is
    written. Its tables go to one folder, which counts once its last file, an empty one, is
    there: a failure between two tables leaves the registry as it was, and the next batch overwrites
    what it left. One writer at a time. Gives the rows of each table of the batch afterwards.
    """
    new = {n: with_defaults(b, n) for n, b in new.items()}
    old = {n: read(spark, root, n) for n in TABLES}
    tables = {}
    for name in TABLES:
        parts = [x for x in (old[name], new.get(name)) if x is not None]
        if parts:
            tables[name] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    usable = tuple(c for c in CONSTRAINTS if c.table in tables and getattr(c, "target", c.table) in tables)
    orphans = [c.name for c in CONSTRAINTS if isinstance(c, Reference) and c.table in new and c.target not in tables]
    broken = {r.constraint_name: r.violations for r in violations(tables, usable).where("violations > 0").collect()} | dict.fromkeys(orphans, -1)
    if broken:
        raise ValueError(f"registry constraints violated: {broken}")
    done = batches(spark, root)
    to = f"{root.rstrip('/')}/b{int(done[-1].rsplit('/b', 1)[1]) + 1 if done else 0}"
    fs, at, path = _folder(spark, to)
    fs.delete(at, True)
    for name, b in new.items():
        b.write.parquet(f"{to}/{name}")
    fs.create(path(at, _DONE)).close()
    return {name: read(spark, root, name).count() for name in new}


def write_index(rows: DataFrame, column: str, path: str, key: str = "row_id") -> None:
    """A secondary index: (column, key) sorted by the column, so that a look-up by it reads the few
    row groups whose bounds hold the value. Nulls are not indexed."""
    rows.where(F.col(column).isNotNull()).select(column, key).repartitionByRange(column, key).sortWithinPartitions(column, key).write.mode("overwrite").parquet(path)


def look_up(spark, path: str, column: str, values: list) -> DataFrame:
    """(column, key) of the given values, through an index."""
    return spark.read.parquet(path).where(F.col(column).isin(values))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def exposures(membership: DataFrame) -> DataFrame:
    """(build_name, row_count, exposures, twice): exposures of each build, and rows exposed in more than one membership."""
    n = F.greatest(F.coalesce("exposure_count", F.lit(0)), F.lit(0))
    rows = membership.groupBy("build_name", "row_id").agg(F.sum(n).alias("e"), F.count_distinct(F.when(n > 0, F.lower(F.trim("membership")))).alias("m"))
    return rows.groupBy("build_name").agg(F.count(F.lit(1)).alias("row_count"), F.sum("e").alias("exposures"), F.count_if(F.col("m") > 1).alias("twice"))
