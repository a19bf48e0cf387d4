"""Queries through files: tables written to the shared folder in each format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.operators import firewall, registry, rules
from sedgeline.plans.base import norm0, query
from sedgeline.session import table
from sedgeline.sources import readers, sinks


def _to(spark, name: str) -> str:
    return f"{scratch.root(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT item_id, text, suite FROM eval_items")
def jsonl_strict(spark, d):
    """The items as JSON lines, read strictly."""
    to = _to(spark, "items")
    sinks.write_json(table(spark, d, "eval_items"), to)
    value = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    return readers.json_strict(spark, to).select(value("item_id").cast("long").alias("item_id"), value("text"), value("suite"))


def _lines(spark, d):
    """Lines of which some are blank, some no JSON, some no object; one file, in the order of the items."""
    raw = F.to_json(F.struct("item_id", "subject"))
    line = F.when(F.col("item_id") % 5 == 1, F.lit(" ")).when(F.col("item_id") % 5 == 2, F.left(raw, F.lit(7))).when(F.col("item_id") % 5 == 3, F.lit("[1]")).otherwise(raw)
    return table(spark, d, "eval_items").select("item_id", line.alias("value"))


@query("""
WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS line FROM eval_items)
SELECT 'line[' || line || ']' AS location, CASE WHEN item_id % 5 = 2 THEN 'invalid JSON' ELSE 'record must be a JSON object' END AS message, 'json_parse' AS kind FROM n WHERE item_id % 5 IN (2, 3)""")
def jsonl_issues(spark, d):
    """The issues of broken lines, by their number in the file, blank lines counted."""
    to = _to(spark, "lines")
    _lines(spark, d).repartitionByRange(1, "item_id").sortWithinPartitions("item_id").select("value").write.text(to)  # one file is the case
    return readers.json_collecting(spark, to)[1]


@query("SELECT item_id, CASE WHEN item_id % 5 IN (0, 4) THEN subject END AS subject FROM eval_items WHERE item_id % 5 IN (0, 4)")
def jsonl_lenient(spark, d):
    """The rows of whole lines; broken ones are nulls, left out here."""
    to = _to(spark, "lines")
    _lines(spark, d).select("value").write.text(to)
    return readers.json_lenient(spark, to, "item_id bigint, subject string").where("item_id is not null")


@query("SELECT record_no, source_id, subject, eligible_behaviors FROM inventory WHERE subject IN ('math', 'physics', 'chemistry', 'biology', 'earth_science')")
def typed_scan(spark, d):
    """Inventory records through JSON lines, checked against schema and rules; strings come back trimmed."""
    to = _to(spark, "inventory")
    known = table(spark, d, "inventory").where(F.col("subject").isin("math", "physics", "chemistry", "biology", "earth_science"))
    padded = known.withColumn("source_id", F.concat(F.lit("  "), "source_id", F.lit("\t")))
    sinks.write_json(padded, to)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields)
    return readers.typed_or_fail(spark, to, schema, rules.inventory_rules()).select("record_no", "source_id", "subject", "eligible_behaviors")


@query("SELECT 'there' AS file, count(*) AS row_count FROM eval_items UNION ALL SELECT 'absent', 0")
def optional_scan(spark, d):
    to = _to(spark, "items")
    sinks.write_json(table(spark, d, "eval_items").select("item_id"), to)
    n = lambda name, path: readers.optional_json(spark, path, "item_id bigint").agg(F.count("item_id").alias("row_count")).select(F.lit(name).alias("file"), "row_count")
    return n("there", to).unionByName(n("absent", f"{to}-absent"))


@query("SELECT id, imported_split, CAST(allowed_use AS VARCHAR) AS allowed FROM sources")
def json_documents(spark, d):
    """The manifest as one document with a map of entries, read as rows."""
    to = _to(spark, "manifest")
    entry = F.struct("imported_split", F.col("allowed_use").cast("string").alias("allowed"))
    whole = table(spark, d, "sources").agg(F.map_from_entries(F.collect_list(F.struct("id", entry))).alias("sources"))  # a manifest of 25 entries
    whole.select(F.to_json(F.struct("sources")).alias("value")).write.text(to)
    return readers.json_entries(spark, f"{to}/part-*", "sources", "imported_split string, allowed string").select(F.col("name").alias("id"), "imported_split", "allowed")


@query("""
SELECT suite, 'sha256:' || sha256(string_agg(text || chr(10), '' ORDER BY item_id)) AS sha256, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM eval_items GROUP BY suite""")
def file_digests(spark, d):
    """Bytes, digest and lines of one text file a suite."""
    return _digests(spark, d).select("suite", "sha256", "n_lines", "bytes")


def _digests(spark, d):
    to = _to(spark, "suites")
    items = table(spark, d, "eval_items").select("suite", "item_id", F.col("text").alias("value"))
    items.repartition("suite").sortWithinPartitions("suite", "item_id").drop("item_id").write.partitionBy("suite").text(to)
    return readers.file_digests(spark, f"{to}/suite=*/*").withColumn("suite", F.regexp_extract("path", "suite=([^/]*)/", 1))


@query("""
SELECT suite, CASE row_number() OVER (ORDER BY suite) % 3 WHEN 1 THEN 'same' WHEN 2 THEN 'changed' ELSE 'missing' END AS status FROM (SELECT DISTINCT suite FROM eval_items)""")
def manifest_check(spark, d):
    """Recorded files against those found: the second of three changed, the third gone."""
    files = scratch.stored(_digests(spark, d).select(F.col("suite").alias("path"), "sha256", "n_lines"), "digests")
    names = [r.path for r in files.select("path").sort("path").collect()]  # a few suites
    change, gone = names[1::3], names[2::3]
    recorded = files.withColumn("n_lines", F.when(F.col("path").isin(change), F.col("n_lines") + 1).otherwise(F.col("n_lines")))
    return firewall.verify_manifest(recorded, files.where(~F.col("path").isin(gone))).withColumnRenamed("path", "suite")


@query(f"""
WITH b AS (SELECT {norm0('text')} IN (SELECT {norm0('text')} FROM eval_items) AS b FROM documents)
SELECT count(*) FILTER (WHERE b IS NOT TRUE) AS kept, count(*) FILTER (WHERE b) AS dropped FROM b""")
def filtered_write(spark, d):
    """Documents written without those that equal an item, both sides counted in the writing job."""
    flagged = firewall.flagged_v0(table(spark, d, "documents"), table(spark, d, "eval_items"))
    n = sinks.filter_on_write(flagged.select("doc_id", "blocked"), ~F.col("blocked"), _to(spark, "kept"))
    return spark.createDataFrame([(n["kept"], n["dropped"])], "kept long, dropped long")


@query("""
SELECT CAST(item_id AS VARCHAR) AS key, CASE WHEN item_id % 4 = 0 THEN 'unknown' WHEN item_id % 4 = 1 THEN 'pending' WHEN item_id % 4 = 2 THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN item_id % 4 = 3 THEN 'refused' END AS error FROM eval_items""")
def download_plan(spark, d):
    """Wanted entries by what is known of them and their last result."""
    items = table(spark, d, "eval_items").select("item_id", F.col("item_id").cast("string").alias("key"))
    tried = items.where("item_id % 4 >= 2").select("key", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("position"), "item_id")
    results = tried.select("key", "position", F.when((F.col("position") == 1) | (F.col("item_id") % 4 == 3), "refused").alias("error"))
    return readers.download_plan(items.select("key"), items.where("item_id % 4 > 0").select("key"), results)


# The registry as files


def _sound(spark, d):
    """The parts of the registry's tables that break no constraint: sources by first key, rows and memberships that refer to them."""
    s, r, m = (table(spark, d, n) for n in registry.TABLES)
    s = scratch.stored(s.dropna(subset=["source_key", "dataset", "revision", "source_split", "original_id", "status"]).dropDuplicates(["source_key"]), "sources")
    columns = ["row_id", "family_id", "selected_behavior", "constraint_signature", "renderer_version", "canonical_content_hash", "template_fingerprint", "status", "source_key"]
    r = r.dropna(subset=columns).groupBy("row_id").agg(F.min_by(F.struct(*[c for c in r.columns if c != "row_id"]), "line_no").alias("r")).select("row_id", "r.*")
    r = r.groupBy("family_id", "selected_behavior", "constraint_signature", "renderer_version").agg(F.min_by(F.struct("row_id", "source_key", "canonical_content_hash", "template_fingerprint", "status"), "line_no").alias("r"))
    r = r.select("family_id", "selected_behavior", "constraint_signature", "renderer_version", "r.*").join(s.select("source_key"), "source_key", "left_semi")
    r = scratch.stored(r.withColumns({"duplicate_of": F.lit(None).cast("string"), "created_at": F.lit(None).cast("timestamp")}), "rows")
    m = m.where(F.col("membership").isin("qa_pilot", "mini_train", "full", "evaluation")).select("build_name", "row_id", "membership").distinct().join(r.select("row_id"), "row_id", "left_semi")
    return s, r, m.withColumns({"exposure_count": F.lit(None).cast("int"), "added_at": F.lit(None).cast("timestamp")})


_SOUND = """
WITH s AS (SELECT DISTINCT source_key FROM source_records WHERE source_key IS NOT NULL AND dataset IS NOT NULL AND revision IS NOT NULL AND source_split IS NOT NULL AND original_id IS NOT NULL AND status IS NOT NULL),
r0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY line_no) AS k FROM training_rows
  WHERE row_id IS NOT NULL AND family_id IS NOT NULL AND selected_behavior IS NOT NULL AND constraint_signature IS NOT NULL AND renderer_version IS NOT NULL AND canonical_content_hash IS NOT NULL AND template_fingerprint IS NOT NULL AND status IS NOT NULL AND source_key IS NOT NULL) WHERE k = 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family_id, selected_behavior, constraint_signature, renderer_version ORDER BY line_no) AS k2 FROM r0) WHERE k2 = 1 AND source_key IN (SELECT source_key FROM s)),
m AS (SELECT DISTINCT build_name, row_id, membership FROM build_membership WHERE membership IN ('qa_pilot', 'mini_train', 'full', 'evaluation') AND row_id IN (SELECT row_id FROM r) AND build_name IS NOT NULL)"""


@query(f"""{_SOUND}
SELECT 'source_records' AS table_name, (SELECT count(*) FROM s) AS row_count, 0 AS exposures UNION ALL SELECT 'training_rows', (SELECT count(*) FROM r), 0 UNION ALL SELECT 'build_membership', (SELECT count(*) FROM m), 0""")
def registry_append(spark, d):
    """The registry built in two batches, each all or nothing, a broken one between them refused; defaults filled in."""
    root = _to(spark, "registry")
    s, r, m = _sound(spark, d)
    registry.append(spark, root, {"source_records": s})
    try:
        registry.append(spark, root, {"training_rows": r, "build_membership": m.withColumn("row_id", F.lit("nowhere"))})
        raise AssertionError("a batch with dangling references was taken")
    except ValueError:
        pass
    registry.append(spark, root, {"training_rows": r, "build_membership": m.where("build_name is not null")})
    out = registry.counts({n: registry.read(spark, root, n) for n in registry.TABLES})
    exposed = registry.read(spark, root, "build_membership").agg(F.sum("exposure_count").alias("e")).first().e or 0
    return out.withColumn("exposures", F.when(F.col("table_name") == "build_membership", F.lit(exposed)).otherwise(0).cast("int"))


@query("SELECT DISTINCT family_id, row_id FROM training_rows WHERE row_id IS NOT NULL AND family_id IN (SELECT min(family_id) FROM training_rows UNION SELECT max(family_id) FROM training_rows)")
def registry_lookup(spark, d):
    """The rows of two families through an index by family."""
    to, rows = _to(spark, "index"), table(spark, d, "training_rows")
    registry.write_index(rows.where("row_id is not null"), "family_id", to)
    ends = rows.agg(F.min("family_id").alias("a"), F.max("family_id").alias("b")).first()
    return registry.look_up(spark, to, "family_id", [ends.a, ends.b]).distinct()


@query("SELECT item_id, subject, text FROM eval_items")
def sqlite_rows(spark, d):
    """The items by way of a SQLite file beside the other intermediate tables, read by tasks in ranges of rowid."""
    import sqlite3
    import tempfile
    from contextlib import closing

    to = f"{_to(spark, 'items')}.sqlite"
    with tempfile.TemporaryDirectory(prefix="sedgeline-sqlite-") as folder:
        made = f"{folder}/items.sqlite"
        with closing(sqlite3.connect(made)) as db:
            db.execute("CREATE TABLE items (item_id INTEGER, subject TEXT, text TEXT)")
            rows = table(spark, d, "eval_items").select("item_id", "subject", "text").toLocalIterator()
            db.executemany("INSERT INTO items VALUES (?, ?, ?)", (tuple(r) for r in rows))
            db.commit()
        # made on a disk of the driver and copied as a whole: the shared folder may be any file system, with locks or without
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at(to).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, at(f"file://{made}"), at(to))
    return readers.sqlite_table(spark, to, "items", "item_id bigint, subject string, text string", rows_a_task=100, frozen=True)
