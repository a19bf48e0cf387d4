"""Taking items up to a budget without sorting them.

Items carry a 30-bit number h. A histogram of their sizes by cell and the first ten
bits shows in which bucket each budget runs out; only that bucket is split by
the next ten bits, then by the last. An item is taken if its h is below the budget's
threshold, so of two budgets on a cell the smaller one takes a part of what the larger takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, LEVEL = 30, 10


def hash_number(*columns) -> Column:
    """A 30-bit number from a hash (MD5, as every engine has it) of columns joined by ``:``; a null column is left out."""
    first = F.conv(F.left(F.md5(F.concat_ws(":", *columns)), F.lit(8)), 16, 10).cast("long")
    return F.shiftright(first, 32 - BITS)


def thresholds(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """(line, threshold): the largest threshold whose items do not exceed the budget.

    items: (cell, h, size), size not negative; budgets: (line, cell, budget), few: a plan's lines. A
    budget of zero or less takes nothing, one that covers its cell everything
    (2^30), one on a cell without items too. Items that share all 30 bits are taken or left together.
    """
    lines = budgets.select("line", "cell", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("done"))
    for level in range(BITS // LEVEL):
        low = BITS - LEVEL * (level + 1)
        bucket = F.shiftright("h", low).cast("long")
        if level:
            open_ = F.broadcast(lines.where("not done").select("cell", "prefix").distinct())
            part = items.withColumn("prefix", F.shiftright(F.col("h"), low + LEVEL).cast("long")).join(open_, ["cell", "prefix"], "left_semi")
        else:
            part = items
        histogram = part.groupBy("cell", bucket.alias("bucket")).agg(F.sum("size").cast("double").alias("in_bucket"))
        histogram = histogram.withColumn("prefix", F.shiftright(F.col("bucket"), LEVEL).cast("long"))
        # at most 2^10 buckets a cell and prefix
        before = F.sum("in_bucket").over(Window.partitionBy("cell", "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        running = histogram.withColumn("before", F.coalesce(before, F.lit(0.0)))
        met = lines.where("not done").join(running, ["cell", "prefix"]).where(F.col("before") + F.col("in_bucket") > F.col("left"))
        cut = met.groupBy("line").agg(F.min(F.struct("bucket", "before")).alias("at")).select("line", F.col("at.bucket").alias("bucket"), F.col("at.before").alias("spent"))
        lines = lines.join(cut, "line", "left").select(
            "line",
            "cell",
            F.when(F.col("done") | F.col("bucket").isNull(), F.col("left")).otherwise(F.col("left") - F.col("spent")).alias("left"),
            # nothing in the level runs the budget out: all of the prefix is taken
            F.when(F.col("done"), F.col("prefix")).when(F.col("bucket").isNotNull(), F.col("bucket")).otherwise(F.shiftleft(F.col("prefix") + 1, LEVEL)).cast("long").alias("prefix"),
            (F.col("done") | F.col("bucket").isNull()).alias("was_done"),
            F.col("done").alias("before_done"),
        )
        # a finished line's prefix is kept at full length
        lines = lines.select(
            "line", "cell", "left", F.when(F.col("before_done"), F.col("prefix")).when(F.col("was_done"), F.shiftleft(F.col("prefix"), low)).otherwise(F.col("prefix")).cast("long").alias("prefix"), F.col("was_done").alias("done")
        )
        lines = _few(lines)
    return lines.select("line", F.col("prefix").alias("threshold"))


def _few(lines: DataFrame) -> DataFrame:
    """A plan's lines, computed here and now: few rows, made constants of later plans."""
    return lines.sparkSession.createDataFrame(lines.toArrow(), schema=lines.schema)
