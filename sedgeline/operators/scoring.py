"""Scores of predictions, and choice among configurations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions import answers, checklist, prompts, text
from sedgeline.joins import attach
from sedgeline.operators import ordinal
from sedgeline.scratch import stored


def latest(predictions: DataFrame, order: str = "position") -> DataFrame:
    """(id, pred): of several predictions of an item the last."""
    p = predictions.select("id", F.struct(order, prompts.prediction(F.col("pred"), F.col("assistant") if "assistant" in predictions.columns else F.lit(None).cast("string")).alias("p")).alias("s"))
    return p.groupBy("id").agg(F.max("s").alias("s")).select("id", F.col("s.p").alias("pred"))


def with_predictions(suite: DataFrame, predictions: DataFrame, order: str = "position") -> DataFrame:
    """The suite with ``pred``, empty where there is none."""
    return suite.join(latest(predictions, order), "id", "left").withColumn("pred", F.coalesce("pred", F.lit("")))


def accuracy(df: DataFrame, correct: Column, *by: str) -> DataFrame:
    """(by, n, correct, acc); a group without rows would have acc 0."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(correct, F.lit(False))).alias("correct"))
    return out.withColumn("acc", F.col("correct") / F.greatest("n", F.lit(1)))


def answer_correct(pred: Column, gold: Column) -> Column:
    g = answers.normalize_answer(gold)
    return (g != "") & (answers.normalize_answer(pred) == g)


def choice_correct(pred: Column, gold: Column) -> Column:
    g = answers.gold_letter(gold)
    return (g != "") & (answers.choice_letter(pred) == g)


def long_enough(pred: Column, user: Column, least: int = 20) -> Column:
    """Soft correctness: more than so many characters; rows without a user text count as wrong."""
    return (F.length(F.coalesce(user, F.lit(""))) > 0) & (F.length(F.trim(F.coalesce(pred, F.lit("")))) > least)


def samples(df: DataFrame, order: str, prompt: str, pred: str, n: int = 3) -> DataFrame:
    """(prompt, pred) of the first evaluated rows, shortened."""
    return df.where(F.length(prompt) > 0).orderBy(order).limit(n).select(text.preview(F.col(prompt), 120).alias("prompt"), text.preview(F.col(pred), 200).alias("pred"))


def checked(df: DataFrame, checks: str = "checks", pred: str = "pred", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, passed, markup_leak, results): each item's checks, the default one where it has none.

    Checks are evaluated in the row's own array: no shuffle, and rows without checks stay.
    """
    names = F.when(F.coalesce(F.size(checks), F.lit(0)) > 0, F.col(checks)).otherwise(F.array(*map(F.lit, checklist.DEFAULT)))
    results = F.transform(names, lambda n: F.struct(n.alias("name"), checklist.check_named(n, F.col(pred)).alias("met")))
    out = df.select("id", *keep, results.alias("results"), F.coalesce(text.has_markup(F.col(pred)), F.lit(False)).alias("markup_leak"))
    return out.select("id", *keep, F.forall("results", lambda r: r["met"]).alias("passed"), "markup_leak", "results")


def checklist_rates(checked_: DataFrame) -> DataFrame:
    """(n, checklist_pass_rate, markup_leak_rate), 0 without rows."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return checked_.agg(F.count(F.lit(1)).alias("n"), rate("passed").alias("checklist_pass_rate"), rate("markup_leak").alias("markup_leak_rate"))


def composite(df: DataFrame, tps: str = "tps", rss: str = "peak_rss_mb", accuracy_: str | None = "arc") -> DataFrame:
    """The rows with s_acc, s_tps, s_mem and composite, unrounded. Null measures count as 0, so do
    null accuracies."""
    s_acc = 100.0 * F.coalesce(F.col(accuracy_).cast("double"), F.lit(0.0)) if accuracy_ else F.lit(0.0)
    s_tps = 100.0 * F.least(F.lit(1.0), F.coalesce(F.col(tps).cast("double"), F.lit(0.0)) / 15.0)
    gb = F.coalesce(F.col(rss).cast("double"), F.lit(0.0)) / 1024.0
    s_mem = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (7.0 - gb) / 7.0))
    out = df.withColumns({"s_acc": s_acc, "s_tps": s_tps, "s_mem": s_mem})
    return out.withColumn("composite", 0.5 * F.col("s_acc") + 0.3 * F.col("s_tps") + 0.2 * F.col("s_mem"))


def within_budget(rss: Column, limit: float = 7000.0) -> Column:
    """Null and zero memory don't pass."""
    return F.coalesce(F.nullif(rss.cast("double"), F.lit(0.0)), F.lit(1e9)) <= limit


def winner(df: DataFrame, order: str, rss: str = "peak_rss_mb", ok: str | None = None) -> DataFrame:
    """The best composite (to two digits) of what is within budget; of equal ones the first. A top-1, not a sort."""
    fit = df.where(within_budget(F.col(rss)) & (F.col(ok) if ok else F.lit(True)))
    return fit.orderBy(F.round("composite", 2).desc(), order).limit(1)


def _front(points: np.ndarray) -> np.ndarray:
    """The places of the rows that no other row equals or beats everywhere and beats somewhere; smaller is
    better. A beaten row comes after its beater in lexicographic order, so one sweep does."""
    order = np.lexsort(points.T[::-1])
    kept = np.empty((0, points.shape[1]))
    out = []
    for i in order:
        p = points[i]
        le = (kept <= p).all(1)
        if not (le & (kept < p).any(1)).any():
            out.append(i)
            if not le.any():  # equal rows need no second entry
                kept = np.vstack([kept, p])
    return np.array(out, np.int64)


def pareto(df: DataFrame, higher: list[str], lower: list[str], rows: int = 100_000) -> DataFrame:
    """The rows that no other row equals or beats everywhere and beats somewhere. Rows with a null measure
    are left out.

    Every partition first keeps its own front of the distinct points; what is left is compared in
    blocks of ``rows`` points, each broadcast, so a front of any size is exact.
    """
    axes = [*higher, *lower]
    sign = np.array([-1.0] * len(higher) + [1.0] * len(lower))
    points = df.select(*(F.col(a).cast("double").alias(a) for a in axes)).dropna().distinct()

    def run(batches):
        kept = np.empty((0, len(axes)))
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns]) * sign
            for a in range(0, len(x), 5000):
                both = np.vstack([kept, x[a : a + 5000]])
                kept = both[_front(both)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kept * sign).T], names=axes)

    front = stored(points.mapInArrow(run, ", ".join(f"`{a}` double" for a in axes)), "front")
    n = front.count()
    out = df.dropna(subset=axes)
    for k in range(max(1, -(-n // rows))):
        block = front.where(F.pmod(F.xxhash64(*axes), F.lit(max(1, -(-n // rows)))) == k)
        other = F.broadcast(block.toDF(*(f"_{a}" for a in axes)))
        no_worse = [F.col(f"_{a}") >= F.col(a) for a in higher] + [F.col(f"_{a}") <= F.col(a) for a in lower]
        better = [F.col(f"_{a}") > F.col(a) for a in higher] + [F.col(f"_{a}") < F.col(a) for a in lower]
        dominated, strict = no_worse[0], better[0]
        for a, b in zip(no_worse[1:], better[1:]):
            dominated, strict = dominated & a, strict | b
        out = out.join(other, dominated & strict, "left_anti")
    return out


def macro_micro(df: DataFrame, value: str, *cell: str) -> DataFrame:
    """(macro, micro): the mean over cells, and over rows."""
    cells = df.groupBy(*cell).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return cells.agg(F.avg("m").alias("macro"), (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("micro"))


def delta(df: DataFrame, key: list[str], version: str, before: str, after: str, value: str) -> DataFrame:
    """(key, before, after, delta) of a measure between two versions."""
    pick = lambda v: F.max(F.when(F.col(version) == v, F.col(value)))
    out = df.groupBy(*key).agg(pick(before).alias("before"), pick(after).alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before"))


def break_even(speed_gain: Column, memory_gain: Column) -> Column:
    """The accuracy that a gain in speed and memory is worth under the composite."""
    return 0.6 * speed_gain + 0.4 * memory_gain


def medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, median) of a measure, exact: rows are numbered in their group over a range partitioning, so a
    group of any size is spread, and the one or two middle rows are averaged. Null measures don't count."""
    placed = stored(ordinal.with_ordinal_by(df.where(F.col(value).isNotNull()).select(*by, value), list(by), value, name="_o"), "placed")
    n = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if not by:
        met = placed.join(F.broadcast(n))
    else:
        met = attach(placed.withColumns({f"_g{i}": F.coalesce(F.col(b).cast("string"), F.lit("\u0000")) for i, b in enumerate(by)}), stored(n.select(*(F.coalesce(F.col(b).cast("string"), F.lit("\u0000")).alias(f"_g{i}") for i, b in enumerate(by)), "_n"), "group-sizes"), [f"_g{i}" for i in range(len(by))], "_n")
    middle = (F.col("_o") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_o") == F.ceil((F.col("_n") - 1) / 2))
    return met.where(middle).groupBy(*by).agg(F.avg(value).alias("median"))


def repeated_runs(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, runs, mean, deviation, median) over repeated runs."""
    n = df.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    m = medians(df, value, *by).toDF(*(f"_k{i}" for i in range(len(by))), "median")
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return n.join(m, same, "left").select(*by, "runs", "mean", "deviation", "median")


def precision_threshold(df: DataFrame, score: str, correct: str, least: float = 0.95) -> DataFrame:
    """(threshold): the lowest score at or above which the share of correct rows is at least ``least``.

    Scores are aggregated first, and summed up over a range partitioning of them, however many there are. Null scores are left out.
    """
    n = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("k"))
    running = ordinal.with_running(n, [F.col(score).desc()], k_sum="k", n_sum="n")
    return running.where(F.col("k_sum") / F.col("n_sum") >= least).agg(F.min(score).alias("threshold"))


def derived(df: DataFrame, suite: str, measure: str, names: dict[str, str], *by: str) -> DataFrame:
    """(by, a column for each of names): measures of suites copied under names of their own, as
    {"forget_proxy": "holdout"}; null where a suite wasn't run. Of several rows of a suite the greatest measure counts."""
    return df.groupBy(*by).agg(*(F.max(F.when(F.col(suite) == s, F.col(measure))).alias(n) for n, s in names.items()))
