"""Row numbers and running totals over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.scratch import stored

#: Bits of Spark's increasing ids that number the rows of a partition.
_ROW_BITS = 33


def _placed(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df range-partitioned and sorted by the keys, with ``_part`` and the row's place in it, ``_rank``,
    from 0. Written, so that every later read sees the same places; rows are numbered where they are."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    place = {"_part": F.shiftright("_id", _ROW_BITS).cast("int"), "_rank": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}
    return stored(ranged.withColumns(place).drop("_id"), name)


def _columns(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 by an order that should be total.

    One shuffle, by range; the partitions' sizes, one number each, give the offsets.
    Ties are numbered in an arbitrary order.
    """
    kept = _placed(df, _columns(order), "ordinal")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    return kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def with_running(df: DataFrame, order: list[Column | str], **sums: str) -> DataFrame:
    """df with running totals: running(..., total="n") adds ``total``, the sum of n up to and with the row.

    Totals run within the partitions of a range partitioning, whose own totals, one row each, are added.
    The order should be total.
    """
    kept = _placed(df, _columns(order), "running")
    of = kept.groupBy("_part").agg(*(F.sum(c).alias(f"_s_{k}") for k, c in sums.items()))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = of.select("_part", *(F.coalesce(F.sum(f"_s_{k}").over(w), F.lit(0)).alias(f"_b_{k}") for k in sums))  # one row a partition
    own = Window.partitionBy("_part").orderBy("_rank")
    each = kept.join(F.broadcast(before), "_part").withColumns({k: F.col(f"_b_{k}") + F.sum(c).over(own) for k, c in sums.items()})
    return each.drop("_part", "_rank", *(f"_b_{k}" for k in sums))


def with_ordinal_by(df: DataFrame, by: list[str], *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 within each group; a group of any size is spread over partitions by its order.

    A null in ``by`` is a group of its own.
    """
    keys = _columns(order)
    kept = _placed(df, [*map(F.col, by), *keys], "ordinal")
    w = Window.partitionBy(*by).orderBy("_part")
    sizes = kept.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_first"))
    # groups x the partitions each lies in: little more rows than groups
    before = sizes.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), F.col("_part").alias("_p"), "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    met = kept.join(before, same)
    return met.withColumn(name, F.col("_before") + F.col("_rank") - F.col("_first")).select(*df.columns, name)


def assign_cycle(df: DataFrame, values: list[str], name: str = "behavior", ordinal: str = "ordinal") -> DataFrame:
    """values in turn, by the ordinal."""
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(ordinal), F.lit(len(values))) + 1).cast("int")))


def ordinal_id(prefix: Column | str, ordinal: Column | str = "ordinal") -> Column:
    """prefix_00042; longer numbers stay whole."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    n = (F.col(ordinal) if isinstance(ordinal, str) else ordinal).cast("string")
    return F.concat(p, F.lit("_"), F.lpad(n, F.greatest(F.lit(5), F.length(n)), F.lit("0")))


def kept_limit(df: DataFrame, keep: Column, limit: int | None, ordinal: str = "ordinal") -> DataFrame:
    """The first ``limit`` rows that meet a condition; ordinals count dropped rows too. None: all."""
    kept = df.where(keep)
    return kept if limit is None else kept.orderBy(ordinal).limit(limit)
