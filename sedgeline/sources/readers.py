"""Reading files: JSON lines strictly, leniently or with issues; manifests, documents, digests, SQLite."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import closing
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from sedgeline.operators import rules


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files, numbered from 1 with blank ones counted.

    Files are split as usual: lines are numbered within their block of the file, in the
    order in which it is read, and the blocks before it are added up. Lines end at newline or
    carriage return only, never at a separator inside a string.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("place"))
    n = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("path", "block", (F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("path", "block").orderBy("place"))
    return raw.withColumn("rank", rank).join(before, ["path", "block"]).select("path", (F.col("before") + F.col("rank")).alias("line"), "value")


def _kept(lines: DataFrame) -> DataFrame:
    return lines.where(F.length(F.regexp_replace("value", r"(?U)[\s\x1c-\x1f]", "")) > 0)


def json_strict(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of JSON objects; anything else is an error with its place. Blank lines are skipped."""
    kind = F.schema_of_variant(F.try_parse_json("value"))
    ok = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    error = F.raise_error(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": expected a JSON object")))
    return _kept(numbered_lines(spark, path)).select("path", "line", F.when(ok, F.col("value")).otherwise(error.cast("string")).alias("value"))


def json_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed rows of JSON lines; blank lines are skipped, broken ones become nulls."""
    return spark.read.schema(schema).json(path)


def json_collecting(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, issues): (path, line, value) of objects, and (location, message, kind) of other lines."""
    lines = _kept(numbered_lines(spark, path)).withColumn("kind", F.schema_of_variant(F.try_parse_json("value")))
    is_object = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    message = F.when(F.col("kind").isNull(), "invalid JSON").otherwise("record must be a JSON object")
    issues = lines.where(~is_object).select(F.concat(F.lit("line["), F.col("line").cast("string"), F.lit("]")).alias("location"), message.alias("message"), F.lit("json_parse").alias("kind"))
    return lines.where(is_object).drop("kind"), issues


def typed_or_fail(spark: SparkSession, path: str, schema: str, checks: Iterable[rules.Rule] = ()) -> DataFrame:
    """Typed rows of JSON lines, strings trimmed; a line that is no JSON object of this schema, has a key
    the schema lacks at any level, or breaks a rule is an error that begins with ``path:line:``.

    Blank lines are skipped. Missing keys are null, for the rules to judge.
    """
    kind = spark.createDataFrame([], schema).schema
    lines = _kept(numbered_lines(spark, path))
    corrupt = StructType([*kind.fields, StructField("_corrupt", StringType())])
    parsed = lines.withColumn("_r", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    extra = rules.unknown_paths(F.col("value"), kind)
    fields = [rules.stripped(F.col("_r")[f.name], f.dataType).alias(f.name) for f in kind.fields]
    flat = parsed.select("path", "line", (~is_object).alias("_bad"), F.col("_r")["_corrupt"].isNotNull().alias("_off"), F.when(is_object, extra).alias("_extra"), *fields)
    broken = rules.compile_issues(checks)
    why = F.coalesce(
        F.when(F.col("_bad"), F.lit("expected a JSON object")),
        F.when(F.col("_off"), F.lit("a value of another type than the schema's")),
        F.when(F.size("_extra") > 0, F.concat(F.lit("unknown keys "), F.array_join("_extra", ", "))),
        F.when(F.size(broken) > 0, F.concat(broken[0]["location"], F.lit(": "), broken[0]["message"])),
    )
    place = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), why)
    # the check is part of the rows' own filter, so that no later plan can leave it out
    return flat.where(F.when(why.isNotNull(), F.raise_error(place).cast("boolean")).otherwise(True)).select(*kind.fieldNames())


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows, none if the file isn't there."""
    return json_lenient(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def inventory_status(spark: SparkSession, path: str | None, root: str = ".") -> tuple[str, str | None]:
    """(status, full path) of a source's inventory: not_configured, missing or loaded."""
    if not path:
        return "not_configured", None
    full = path if "://" in path or path.startswith("/") else f"{root.rstrip('/')}/{path}"
    return ("loaded" if _exists(spark, full) else "missing"), full


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One row a file that holds one JSON document."""
    return spark.read.option("multiLine", True).json(path)


def json_entries(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """(name, fields) of a map inside a JSON document."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json(F.get_json_object("value", f"$.{field}"), f"map<string,struct<{schema}>>")).alias("name", "v")).select("name", "v.*")


def manifest(spark: SparkSession, path: str, field: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a list in a YAML or JSON mapping, a small file read by the driver. YAML needs its library.

    Strings are trimmed. strict: an entry with a key that the schema lacks is an error, else the key is ignored.
    """
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML manifests needs PyYAML; use JSON instead") from e
        value = yaml.safe_load(raw)
    else:
        value = json.loads(raw)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: expected a mapping")
    entries = value.get(field) or []
    kind = spark.createDataFrame([], schema).schema
    for k, entry in enumerate(entries):
        if not isinstance(entry, dict):
            raise ValueError(f"{path}: {field}[{k}]: expected a mapping")
        extra = sorted(set(entry) - set(kind.fieldNames()))
        if strict and extra:
            raise ValueError(f"{path}: {field}[{k}]: unknown keys {', '.join(extra)}")
    clean = [tuple(v.strip() if isinstance(v := e.get(n), str) else v for n in kind.fieldNames()) for e in entries]
    return spark.createDataFrame(clean, kind)


def tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, n_lines) of files, sorted by path; a last line without an end counts.

    path may be a file, a folder or a pattern. Tasks stream a file in pieces of 1 MiB, so that its size doesn't matter.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []  # names and sizes only, as Spark lists files too; empty ones are files as well
    for entry in system.globStatus(at) or []:
        files = system.listFiles(entry.getPath(), True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith((".", "_")):
                uri = f.getPath().toUri().toString()
                found.append((uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, f.getLen()))
    listed = spark.createDataFrame(found, "path string, length long")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            paths, digests, lines = batch.column(0).to_pylist(), [], []
            for p in paths:
                system, at = fs.FileSystem.from_uri(p)
                sha, n, last = hashlib.sha256(), 0, b"\n"
                with system.open_input_stream(at) as f:
                    while piece := f.read(1 << 20):
                        sha.update(piece)
                        n += piece.count(b"\n")
                        last = piece[-1:]
                digests.append(f"sha256:{sha.hexdigest()}")
                lines.append(n + (last != b"\n"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests), pa.array(lines, type=pa.int64())], names=["path", "bytes", "sha256", "n_lines"])

    return listed.repartition("path").mapInArrow(run, "path string, bytes bigint, sha256 string, n_lines bigint").orderBy("path")


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str, rows_a_task: int = 1_000_000, frozen: bool = False) -> DataFrame:
    """A table of a SQLite file, read by tasks in ranges of rowid.

    path: as Spark's other readers have it, with or without a scheme. On a disk, which all executors must share, tasks open
    the file in place. SQLite reads at random, so of a file on another system the driver and each executor keep one copy, to which
    its write-ahead log must have been added. frozen: nothing writes to the file any more, so it is opened without locks,
    which some shared folders lack.

    The driver asks for the smallest and greatest rowid only. A table without rowids is streamed by one task.
    """
    kind = spark.createDataFrame([], schema).schema
    wanted = ", ".join(f'"{f.name}"' for f in kind.fields)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source = system.makeQualified(at(path))
    place, fetched = source.toUri().getPath(), None
    if source.toUri().getScheme() != "file":
        folder = tempfile.mkdtemp(prefix="sedgeline-sqlite-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        fetched, frozen = f"{uuid.uuid4().hex}.sqlite", True
        place = f"{folder}/{fetched}"
        system.copyToLocalFile(False, source, at(f"file://{place}"), True)
        spark.sparkContext.addFile(place)

    def opened(place):
        return closing(sqlite3.connect(f"{Path(place).as_uri()}?mode=ro{'&immutable=1' if frozen else ''}", uri=True))

    with opened(place) as db:
        try:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
            ranges = [] if low is None else [(a, a + rows_a_task) for a in range(low, high + 1, rows_a_task)]
        except sqlite3.OperationalError as e:
            if "rowid" not in str(e):
                raise
            ranges = [(None, None)]
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for low, high in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(SparkFiles.get(fetched) if fetched else place) as db:
                    part = "" if low is None else f" WHERE rowid >= {low} AND rowid < {high}"
                    cursor = db.execute(f'SELECT {wanted} FROM "{name}"{part}')
                    while rows := cursor.fetchmany(20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    if not ranges:
        return spark.createDataFrame([], kind)
    return spark.createDataFrame(ranges, "low long, high long").repartition(len(ranges)).mapInArrow(run, kind)


def download_plan(wanted: DataFrame, known: DataFrame, results: DataFrame | None = None, key: str = "key") -> DataFrame:
    """(key, status, error): each wanted entry: unknown, or by its last result (key, position, error) ok or
    error, or pending without one."""
    named = wanted.join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left")
    if results is None:
        return named.select(key, F.when(F.col("_k"), "pending").otherwise("unknown").alias("status"), F.lit(None).cast("string").alias("error"))
    last = results.groupBy(key).agg(F.max(F.struct("position", "error")).alias("_l"))
    status = F.when(F.col("_k").isNull(), "unknown").when(F.col("_l").isNull(), "pending").when(F.col("_l.error").isNull(), "ok").otherwise("error")
    return named.join(last, key, "left").select(key, status.alias("status"), F.when(F.col("_k"), F.col("_l.error")).alias("error"))
