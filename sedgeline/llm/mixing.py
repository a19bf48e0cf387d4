"""Mixing sources to target shares of the whole size, with capped repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm import budgets, common
from sedgeline.sizing import small


def lines(plan: DataFrame) -> DataFrame:
    """The plan's lines, numbered; dataset trimmed and in lower case."""
    order = Window.partitionBy("mix_name").orderBy("dataset_out", "license_class", "target_share", "max_repeats")
    out = plan.select("mix_name", common.dataset_name(F.col("dataset")).alias("dataset_out"), common.dataset_key(F.col("dataset")).alias("dataset_key"), "license_class", "target_share", "max_repeats", "mix_chars")
    return out.withColumn("line", F.concat_ws("#", "mix_name", F.row_number().over(order)))


def records(inventory: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_no, cell, h, size) of records with a known source and a prompt; cell: its dataset and license class."""
    of = sources.select(F.col("id").alias("source_id"), F.struct(common.dataset_key(F.col("dataset")).alias("dataset_key"), F.col("license_class")).alias("cell")).where("source_id is not null").dropDuplicates(["source_id"])
    mine = inventory.select(F.col("record_no").cast("long").alias("record_no"), "source_id", F.length("canonical_prompt").alias("size")).where("size is not null")
    return mine.join(small(of), "source_id").select("record_no", "cell", budgets.hash_number(F.lit("mix"), F.col("record_no").cast("string")).alias("h"), "size")


def supply(plan: DataFrame, inventory: DataFrame, sources: DataFrame) -> DataFrame:
    """The plan's lines with ``supply``, the characters of their records (0 without any),
    summed from the histogram by source and hash bucket."""
    histogram = records(inventory, sources).groupBy("cell", F.shiftright("h", budgets.BITS - budgets.LEVEL).alias("bucket")).agg(F.sum("size").alias("size"))
    total = histogram.groupBy("cell").agg(F.sum("size").alias("supply")).select("cell.*", "supply")
    a, b = lines(plan).alias("a"), small(total).alias("b")
    same = (F.col("a.dataset_key") == F.col("b.dataset_key")) & F.col("a.license_class").eqNullSafe(F.col("b.license_class"))
    return a.join(b, same, "left").select("a.*", F.coalesce("b.supply", F.lit(0)).alias("supply"))


def found(plan: DataFrame, inventory: DataFrame, sources: DataFrame) -> DataFrame:
    """(mix_name, dataset) of the lines whose target exceeds what the allowed repeats of their records give.

    Null shares, repeats or sizes ask for nothing. A null license class means sources with a null one.
    """
    short = F.col("target_share") * F.col("mix_chars") > F.col("max_repeats") * F.col("supply")
    return supply(plan, inventory, sources).where(short).select("mix_name", F.col("dataset_out").alias("dataset"))


def _drawn(plan: DataFrame, inventory: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, draws): lines with full passes and the threshold of the last, partial one."""
    want = F.greatest(F.coalesce(F.col("target_share") * F.col("mix_chars"), F.lit(0.0)), F.lit(0.0))
    most = F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    full = F.when(F.col("supply") > 0, F.least(F.floor(want / F.col("supply")), most)).otherwise(0).cast("int")
    planned = budgets._few(supply(plan, inventory, sources).withColumn("full", full).withColumn("rest", F.when(F.col("full") < most, want - F.col("full") * F.col("supply")).otherwise(0.0)).withColumn("cell", F.struct("dataset_key", "license_class")))
    cell = F.to_json("cell")
    items = records(inventory, sources).withColumn("cell", cell)
    cut = budgets.thresholds(items, planned.select("line", cell.alias("cell"), F.col("rest").alias("budget")))
    planned = planned.withColumn("cell", cell).join(small(cut), "line")
    drawn = items.join(small(planned), "cell").withColumn("repeats", F.col("full") + ((F.col("h") < F.col("threshold")) & (F.col("rest") > 0)).cast("int"))
    return planned, drawn.where("repeats > 0")


def draw(plan: DataFrame, inventory: DataFrame, sources: DataFrame) -> DataFrame:
    """(mix_name, dataset, license_class, record_no, repeats): the mix. Every record of a
    line is repeated floor(target / supply) times, at most max_repeats, and once more if its hash is
    below the threshold at which the rest of the target is reached."""
    return _drawn(plan, inventory, sources)[1].select("mix_name", F.col("dataset_out").alias("dataset"), "license_class", "record_no", "repeats")


def shares(plan: DataFrame, inventory: DataFrame, sources: DataFrame) -> DataFrame:
    """(mix_name, dataset, license_class, target_share, share, chars, short): what the mix reaches,
    share being of mix_chars; short: the target can't be met within max_repeats."""
    planned, drawn = _drawn(plan, inventory, sources)
    got = drawn.groupBy("line").agg(F.sum(F.col("size") * F.col("repeats")).alias("chars"))
    out = planned.join(small(got), "line", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    short = F.coalesce(F.col("target_share") * F.col("mix_chars") > F.col("max_repeats") * F.col("supply"), F.lit(False))
    return out.select("mix_name", F.col("dataset_out").alias("dataset"), "license_class", "target_share", F.round(F.when(F.col("mix_chars") > 0, F.col("chars") / F.col("mix_chars")), 6).alias("share"), "chars", short.alias("short"))
