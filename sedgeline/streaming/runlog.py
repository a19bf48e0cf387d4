"""Run-event logs: items opened and closed by events, rolled up in batch or as a stream.

An item_start opens an item and interrupts one that is still open; item_ok, item_error and
item_skip close the open item of their key, or are an item of no length; run_finish closes what is open as
interrupted, and what follows it is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "run_id string, seq bigint, ts timestamp, event string, key string, status string"
CLOSING = {"item_ok": "ok", "item_error": "error", "item_skip": "skipped"}
STATUSES = ("ok", "error", "skipped", "interrupted", "running")


def read_events(spark, path: str, schema: str = EVENTS) -> DataFrame:
    """A stream of appended JSON event files."""
    return spark.readStream.schema(schema).json(path)


def items(events: DataFrame) -> DataFrame:
    """(run_id, key, status, started, finished) of all items, by windows over each run's events.

    An open item reaches to the next start, close of its key, or end of the run.
    """
    w = Window.partitionBy("run_id").orderBy("seq")
    ended = F.max(F.when(F.col("event") == "run_finish", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = events.withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0").where(F.col("event").isin("item_start", "run_finish", *CLOSING))
    # the start that is open before an event, if no event closed it since
    span = live.withColumn("_n", F.sum(F.when(F.col("event") == "item_start", 1).otherwise(0)).over(w))
    of = Window.partitionBy("run_id", "_n").orderBy("seq")
    opened = F.first(F.when(F.col("event") == "item_start", F.struct("key", "ts"))).over(of)
    closes = F.col("event").isin(*CLOSING) & F.col("key").eqNullSafe(F.col("_open.key")) & (F.col("_n") > 0)
    span = span.withColumn("_open", opened).withColumn("_closes", closes)
    before = F.coalesce(F.max(F.col("_closes").cast("int")).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = span.withColumn("_own", F.col("_closes") & (before == 0))
    status = F.coalesce(*(F.when(F.col("event") == e, s) for e, s in CLOSING.items()))
    closed = span.where(F.col("event").isin(*CLOSING)).select("run_id", "key", status.alias("status"), F.when(F.col("_own"), F.col("_open.ts")).otherwise(F.col("ts")).alias("started"), F.col("ts").alias("finished"))
    ends = span.groupBy("run_id", "_n").agg(F.max(F.col("_own").cast("int")).alias("closed"), F.min(F.when(F.col("event") == "item_start", F.struct("key", "ts"))).alias("s"), F.min(F.when(F.col("event") == "run_finish", F.col("ts"))).alias("finish"))
    after = F.lead(F.col("s.ts")).over(Window.partitionBy("run_id").orderBy("_n"))
    left = ends.withColumn("_next", after).where("_n > 0 and closed = 0")
    end = F.coalesce("_next", "finish")
    return closed.unionByName(left.select("run_id", F.col("s.key").alias("key"), F.when(end.isNull(), "running").otherwise("interrupted").alias("status"), F.col("s.ts").alias("started"), end.alias("finished")))


def run_status(error: Column, ok: Column, interrupted: Column) -> Column:
    return F.when((error > 0) & (ok > 0), "partial").when(error > 0, "error").when(interrupted > 0, "interrupted").otherwise("ok")


def rollup(events: DataFrame) -> DataFrame:
    """(run_id, ok, error, skipped, interrupted, total, status, partial): of every run; status is running until it finished.

    Items still open count in nothing, as they aren't over.
    """
    per = items(events).where("status <> 'running'").groupBy("run_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES[:4]), F.count(F.lit(1)).alias("total"))
    runs = events.groupBy("run_id").agg(F.bool_or(F.col("event") == "run_finish").alias("_over"), F.min_by("status", F.when(F.col("event") == "run_finish", F.col("seq"))).alias("_given"))
    out = runs.join(per, "run_id", "left").fillna(0, [*STATUSES[:4], "total"])
    given = F.when(F.col("_over"), F.coalesce("_given", run_status(F.col("error"), F.col("ok"), F.col("interrupted")))).otherwise("running")
    return out.select("run_id", *STATUSES[:4], "total", given.alias("status"), (~F.col("_over")).alias("partial"))


_STATE = "open_key string, is_open boolean, ok bigint, error bigint, skipped bigint, interrupted bigint, finished boolean, status string"
_OUT = "run_id string, ok bigint, error bigint, skipped bigint, interrupted bigint, total bigint, status string, partial boolean"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # finished, and too long ago for events that may still come
        state.remove()
        return
    open_key, is_open, ok, error, skipped, interrupted, finished, status = state.get if state.exists else (None, False, 0, 0, 0, 0, False, None)
    n = {"ok": ok, "error": error, "skipped": skipped, "interrupted": interrupted}
    watermark = state.getCurrentWatermarkMs()
    events = pd.concat(list(batches))
    events = events[events.ts.astype("datetime64[ms]").astype("int64") >= watermark]
    if not state.exists and events.empty:
        return  # nothing but late events, of a run whose state may be gone
    events = events[events.event.isin(["item_start", "run_finish", *CLOSING])]
    for e in events.sort_values("seq").itertuples():
        if finished:
            break
        if e.event == "item_start":
            n["interrupted"] += int(is_open)
            open_key, is_open = e.key, True
        elif e.event in CLOSING:
            n[CLOSING[e.event]] += 1
            if is_open and open_key == e.key:
                open_key, is_open = None, False
        elif e.event == "run_finish":
            n["interrupted"] += int(is_open)
            open_key, is_open, finished = None, False, True
            status = e.status if isinstance(e.status, str) else "partial" if n["error"] and n["ok"] else "error" if n["error"] else "interrupted" if n["interrupted"] else "ok"
    state.update((open_key, is_open, n["ok"], n["error"], n["skipped"], n["interrupted"], finished, status))
    if finished:
        newest = 0 if events.empty else int(events.ts.astype("datetime64[ms]").astype("int64").max())
        state.setTimeoutTimestamp(max(watermark, newest) + 1)
    yield pd.DataFrame([[key[0], n["ok"], n["error"], n["skipped"], n["interrupted"], sum(n.values()), status if finished else "running", not finished]], columns=[f.split()[0] for f in _OUT.split(", ")])


def rollup_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """As ``rollup``, of a stream of events, in update mode: a row for each run that a batch touches.

    Events of a run are taken in the order of seq within a batch; a batch holds
    no event older than those of the batches before. State is a few numbers a run; a finished run's is removed
    once the watermark, ``late`` behind the newest event, has passed its last event, and events older than the
    watermark are left out, so that they can't open it again.
    """
    return events.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(_advance, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def append_events(events: DataFrame, path: str, checkpoint: str | None = None):
    """Append events to JSON files: a batch at once; a stream through a query that is given back, which ends once all
    that is there was written."""
    if not events.isStreaming:
        events.write.mode("append").json(path)
        return None
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, by, n, total): events counted by tumbling or sliding windows; of a stream, events
    later than ``late`` are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = timed.withWatermark(ts, late) if events.isStreaming else timed
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return marked.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


# How log lines name events.
LABELS = {"item_start": "START", "item_ok": "OK", "item_error": "FAIL", "item_skip": "SKIP", "item_interrupted": "INTERRUPTED", "run_start": "RUN", "run_finish": "DONE"}


def log_line(stage: Column, event: Column, key: Column, status: Column, message: Column, extras: Column) -> Column:
    """A log line: stage, label, key or status, message, and other fields in brackets, long ones left out."""
    label = F.coalesce(*(F.when(event == e, v) for e, v in LABELS.items()), F.upper(event))
    shown = F.map_filter(extras, lambda k, v: ~k.isin("key", "status", "traceback", "meta") & v.isNotNull())
    listed = F.array_join(F.transform(F.map_entries(shown), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    who = F.when(event.startswith("item_"), key).when(event == "run_finish", status)
    return F.concat_ws(" ", F.concat(F.lit("["), stage, F.lit("]")), label, who, F.when(message.isNotNull(), F.concat(F.lit("— "), message)), F.when(listed != "", F.concat(F.lit("("), listed, F.lit(")"))))
