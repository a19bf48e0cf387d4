import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sedgeline.operators import rules
from sedgeline.sources import readers, sinks
from sedgeline.streaming import runlog


def write(path, content):
    path.write_bytes(content.encode())
    return str(path)


def test_lines_and_issues(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"a": "x y"}\n\n  \n[1]\nnot json\r\n{"a": 2}\n')
    records, issues = readers.json_collecting(spark, p)
    assert sorted(r.line for r in records.collect()) == [1, 6]
    assert {(r.location, r.message) for r in issues.collect()} == {("line[4]", "record must be a JSON object"), ("line[5]", "invalid JSON")}
    with pytest.raises(Exception, match="expected a JSON object"):
        readers.json_strict(spark, p).collect()
    good = write(tmp_path / "b.jsonl", '{"a": 1}\n')
    assert readers.json_strict(spark, good).count() == 1
    assert readers.json_lenient(spark, good, "a int").first().a == 1
    with pytest.raises(Exception):
        readers.typed_or_fail(spark, write(tmp_path / "c.jsonl", '{"a": "x"}\n'), "a int").collect()


def test_typed_lines_fail_with_their_place(spark, tmp_path):
    kind = "a int, b struct<c:string>, d array<struct<e:int>>"
    read = lambda name, line, checks=(): readers.typed_or_fail(spark, write(tmp_path / name, '{"a": 1, "b": {"c": " x "}}\n\n' + line), kind, checks).collect()
    assert [(r.a, r.b) for r in read("ok", '{"a": 2}\n')] == [(1, ("x",)), (2, None)]
    for name, line, why in (("t", '{"a": "x"}', "another type"), ("k", '{"z": 1}', "unknown keys z"), ("n", '{"b": {"y": 1}}', "unknown keys b.y"), ("l", '{"d": [{"e": 1}, {"f": 1}]}', r"unknown keys d\[\].f"), ("o", "[]", "JSON object"), ("j", "{", "JSON object")):
        with pytest.raises(Exception, match=f"/{name}:3: .*{why}"):
            read(name, line)
    with pytest.raises(Exception, match="/r:3: a: Field required"):
        read("r", '{"b": null}', [rules.missing("a")])
    assert readers.typed_or_fail(spark, write(tmp_path / "empty", ""), kind).count() == 0


def test_manifests_are_strict(spark, tmp_path):
    p = write(tmp_path / "m.json", json.dumps({"sources": [{"id": " s ", "x": 1}]}))
    with pytest.raises(ValueError, match="unknown keys x"):
        readers.manifest(spark, p, "sources", "id string")
    assert readers.manifest(spark, p, "sources", "id string", strict=False).first().id == "s"


def test_digests_of_files_of_any_size(spark, tmp_path):
    import hashlib

    big = b"x" * (3 << 20) + b"\nlast"
    for name, content in (("big", big), ("empty", b""), ("ended", b"a\nb\n")):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256, r.n_lines) for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n: (len(c), "sha256:" + hashlib.sha256(c).hexdigest(), k) for n, c, k in (("big", big, 2), ("empty", b"", 0), ("ended", b"a\nb\n", 2))}


def test_small_files(spark, tmp_path):
    assert readers.optional_json(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    assert readers.inventory_status(spark, None)[0] == "not_configured"
    assert readers.inventory_status(spark, "none.jsonl", str(tmp_path))[0] == "missing"
    p = write(tmp_path / "r.json", json.dumps({"checks": {"c": {"type": "semantic", "dimension": "d"}}, "sources": [{"id": "s", "n": 1}]}))
    assert readers.inventory_status(spark, p)[0] == "loaded"
    assert readers.json_entries(spark, p, "checks", "type:string,dimension:string").first().asDict() == {"name": "c", "type": "semantic", "dimension": "d"}
    assert readers.manifest(spark, p, "sources", "id string, n long").first().id == "s"
    assert readers.json_document(spark, p).count() == 1
    with pytest.raises(ValueError, match="mapping"):
        readers.manifest(spark, write(tmp_path / "l.json", "[]"), "x", "a int")
    d = readers.file_digests(spark, p).first()
    import hashlib

    assert d.sha256 == "sha256:" + hashlib.sha256((tmp_path / "r.json").read_bytes()).hexdigest()


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "r.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table t (a text, b integer)")
        db.executemany("insert into t values (?, ?)", [("x", 1), (None, 2)])
    assert readers.sqlite_table(spark, path, "t", "a string, b long").count() == 2
    with sqlite3.connect(path) as db:
        db.executemany("insert into t values (?, ?)", [(str(i), i) for i in range(25)])
        db.execute("create table w (k text primary key, n integer) without rowid")
        db.execute("insert into w values ('a', 1)")
        db.execute("create table e (a text)")
    assert readers.sqlite_table(spark, path, "t", "b long", rows_a_task=4).agg(F.sum("b")).first()[0] == 303
    assert [tuple(r) for r in readers.sqlite_table(spark, path, "w", "k string, n long").collect()] == [("a", 1)]
    assert readers.sqlite_table(spark, path, "e", "a string").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "p"), (2, None, "q")], "a int, b string, export_profile string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_report(df, str(tmp_path / "x" / "r.json"))
    assert json.loads((tmp_path / "x" / "r.json").read_text())[0]["b"] == "é"
    assert sinks.markdown(df, "a").splitlines()[2] == "| 1 | é | p |"
    assert sinks.filter_on_write(df, F.col("a") > 1, str(tmp_path / "f")) == {"kept": 1, "dropped": 1}
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.markdown(df, "a", rows=1)
    sinks.write_by_license(df, str(tmp_path / "l"))
    assert {p.name for p in (tmp_path / "l").glob("export_profile=*")} == {"export_profile=p", "export_profile=q"}
    assert sinks.json_schema(df, "t", "urn:t")["properties"]["a"] == {"type": "integer"}
    schema = sinks.json_schema(spark.createDataFrame([], rules.CANONICAL), "record", "urn:r", rules.canonical_rules("v1"))
    assert schema["properties"]["split"]["enum"] == ["train", "validation", "test", "external_eval"] and "id" in schema["required"]
    assert schema["properties"]["quality"]["properties"]["factual_score"] == {"type": "number", "minimum": 0, "maximum": 1}
    assert schema["properties"]["identity"]["properties"]["row_id"]["pattern"].startswith("^sha256")
    assert schema["properties"]["messages"]["minItems"] == 2 and schema["properties"]["schema_version"]["enum"] == ["v1"]


EVENTS = [
    # run, event, key, status
    ("partial", "item_start", "a", None), ("partial", "item_ok", "a", None), ("partial", "item_start", "b", None), ("partial", "item_error", "b", None), ("partial", "run_finish", None, None),
    ("error", "item_error", "a", None), ("error", "run_finish", None, None), ("error", "run_finish", None, "ok"),
    ("cut", "item_start", "a", None), ("cut", "item_start", "b", None), ("cut", "run_finish", None, None), ("cut", "item_ok", "z", None),
    ("skip", "item_skip", "a", None), ("skip", "run_finish", None, None),
    ("given", "item_error", "a", None), ("given", "run_finish", None, "ok"),
    ("open", "item_start", "a", None), ("open", "item_ok", "other", None), ("open", "info", None, None),
    ("empty", "run_start", None, None),
]
WANT = {"partial": (1, 1, 0, 0, 2, "partial", False), "error": (0, 1, 0, 0, 1, "error", False), "cut": (0, 0, 0, 2, 2, "interrupted", False), "skip": (0, 0, 1, 0, 1, "ok", False), "given": (0, 1, 0, 0, 1, "ok", False), "open": (1, 0, 0, 0, 1, "running", True), "empty": (0, 0, 0, 0, 0, "running", True)}


def log(spark):
    rows = [(r, i, i, e, k, s) for i, (r, e, k, s) in enumerate(EVENTS)]
    return spark.createDataFrame(rows, "run_id string, seq long, t long, event string, key string, status string").select("run_id", "seq", F.timestamp_seconds("t").alias("ts"), "event", "key", "status")


def shape(rows):
    return {r.run_id: (r.ok, r.error, r.skipped, r.interrupted, r.total, r.status, r.partial) for r in rows}


def test_rollup(spark):
    assert shape(runlog.rollup(log(spark)).collect()) == WANT
    items = {(r.run_id, r.key): r.status for r in runlog.items(log(spark)).collect()}
    assert items["cut", "a"] == "interrupted" and items["open", "a"] == "running" and ("cut", "z") not in items


def test_stream_gives_the_same(spark, tmp_path):
    folder = str(tmp_path / "events")
    log(spark).where("seq < 9").write.mode("append").json(folder)
    q = runlog.rollup_stream(runlog.read_events(spark, folder)).writeStream.outputMode("update").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        log(spark).where("seq >= 9").write.mode("append").json(folder)
        q.processAllAvailable()
        last = {}
        for r in spark.table("runs").collect():
            if r.run_id not in last or r.total >= last[r.run_id].total:
                last[r.run_id] = r
        assert shape(last.values()) == WANT
    finally:
        q.stop()


def test_finished_runs_leave_the_state(spark, tmp_path):
    folder = str(tmp_path / "events")
    at = lambda *rows: spark.createDataFrame(list(rows), "run_id string, seq long, t long, event string, key string, status string").select("run_id", "seq", F.timestamp_seconds("t").alias("ts"), "event", "key", "status")
    runlog.append_events(at(("a", 1, 100, "item_ok", "k", None), ("a", 2, 101, "run_finish", None, None)), folder)
    q = runlog.rollup_stream(runlog.read_events(spark, folder), late="10 seconds").writeStream.outputMode("update").format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        runlog.append_events(at(("b", 3, 500, "item_start", "k", None)), folder)
        q.processAllAvailable()
        runlog.append_events(at(("b", 4, 501, "item_ok", "k", None), ("a", 5, 102, "item_error", "k", None)), folder)
        q.processAllAvailable()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
        assert [(r.ok, r.error, r.status) for r in spark.table("expiring").where("run_id = 'a'").collect()] == [(1, 0, "ok")]
    finally:
        q.stop()


def test_windows_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    want = {(r.window_start, r.event_type): r.n for r in runlog.windowed_counts(events, window="1 hour").collect()}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").symlink_to(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = runlog.windowed_counts(stream, window="1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    try:
        q.processAllAvailable()
        assert {(r.window_start, r.event_type): r.n for r in spark.table("hours").collect()} == want
    finally:
        q.stop()


def test_log_lines(spark):
    line = lambda e, k, s, m, x: spark.range(1).select(runlog.log_line(F.lit("s"), F.lit(e), F.lit(k), F.lit(s), F.lit(m), x).alias("v")).first().v
    none = F.create_map().cast("map<string,string>")
    assert line("item_ok", "k", "ok", None, F.create_map(F.lit("n"), F.lit("1"), F.lit("meta"), F.lit("m"))) == "[s] OK k (n=1)"
    assert line("run_finish", None, "partial", "done", none) == "[s] DONE partial — done"
    assert line("warn", None, None, "careful", none) == "[s] WARN — careful"
