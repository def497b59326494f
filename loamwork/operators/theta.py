"""Joins on any condition: one side goes to every task while it is small, else both are dealt to a grid of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hotkeys import KINDS, hot_key_join
from .inequalities import join_of_pairs
from .stages import staged

#: Rows that a side may have to be broadcast.
MOST_ROWS = 100_000

#: Rows of a side in a cell of the grid.
CELL_ROWS = 1 << 15


def theta_join(large: DataFrame, small: DataFrame, condition: Column | None, how: str = "inner", most_rows: int = MOST_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """A join on a condition without an equality; None pairs all rows.

    The size of ``small`` is counted first. Up to ``most_rows`` rows are broadcast
    for a nested loop. With more, or for right and full, all rows count as rows of one
    key that is hot on both sides (:func:`hot_key_join`): every pair is tried in one
    cell, and no cell has more than about ``cell_rows`` rows of a side. As any such
    join it is work in the product of the sides; if the condition has an inequality
    that most pairs fail, :func:`inequality_join` is the better way, and for points in
    intervals or overlaps :func:`range_join` and :func:`overlap_join`.

    ``how`` may be inner, left, right, full, left_semi or left_anti. Column names must
    differ between the sides, and the condition must name columns, not frames.
    """
    if how not in KINDS:
        raise ValueError(f"no theta join of kind {how}")
    if how not in ("right", "full") and small.limit(most_rows + 1).count() <= most_rows:
        if condition is None and how == "inner":
            return large.crossJoin(F.broadcast(small))
        return large.join(F.broadcast(small), F.lit(True) if condition is None else condition, how)
    a, b = (staged(side.withColumn("__id", F.monotonically_increasing_id()), "side").df for side in (large, small))
    lefts = a.withColumnRenamed("__id", "left_id").withColumn("__all_l", F.lit(0))
    rights = b.withColumnRenamed("__id", "right_id").withColumn("__all_r", F.lit(0))
    met = hot_key_join(lefts, rights, "__all_l", "__all_r", "inner", cell_rows)
    met = met if condition is None else met.where(condition)
    if how == "inner":
        return met.select(*large.columns, *small.columns)
    return join_of_pairs(a, b, met.select("left_id", "right_id"), None, how)
