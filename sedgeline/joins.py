"""Joins of rows with their groups, where one group may hold much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a group is joined by broadcast, and the most such groups.
HOT_ROWS, HOT_GROUPS = 5000, 10_000


def attach(rows: DataFrame, groups: DataFrame, by: list[str], size: str) -> DataFrame:
    """rows joined with their group, one row of ``groups`` a group, of ``size`` rows.

    Groups of more than ``HOT_ROWS`` rows (or total / ``HOT_GROUPS``, if that is more:
    so there are at most 10,000) are broadcast, and their rows stay where they
    are; the others share a shuffle join without hot keys. groups should be stored.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(size) > least))
    rest = rows.join(hot.select(*by), by, "left_anti").join(groups.where(F.col(size) <= least), by)
    return rows.join(hot, by).unionByName(rest)
