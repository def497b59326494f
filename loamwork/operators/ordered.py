"""Ranks and running totals over the order of a whole table, without a task that holds it.

A prefix scan: rows are dealt to ranges of the order, each range is scanned on its
own, and what the ranges before it add up to, one row a range, is added. The number
of ranges follows from the number of rows. Rows that tie are no problem of one range
where they need not be told apart: ranks are taken over the distinct values, which
are counted before they are dealt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import staged

#: Rows of a range, about.
RANGE_ROWS = 1 << 19

_LOCAL = (1 << 33) - 1  # monotonically_increasing_id is partition << 33 | place in it


def _ranged(df: DataFrame, order: Sequence[Column], range_rows: int) -> DataFrame:
    """``df`` as a table with __range and __seq, places in the order; what ties beyond ``order`` is told apart by where it was read."""
    parts = max(1, -(-df.count() // range_rows))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    at = F.monotonically_increasing_id()
    placed = dealt.withColumn("__at", at)
    return staged(placed.withColumn("__range", F.shiftright("__at", 33)).withColumn("__seq", F.col("__at").bitwiseAND(_LOCAL)).drop("__at"), "ranges").df


def _before(parts: DataFrame, aggregates: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """What the ranges before each add up to: a row a range, so a window over all of them is small."""
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col("__range").alias("__of"), *[over.over(earlier).alias(f"__before_{name}") for name, (_, over) in aggregates.items()])


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the number of each row in the order, from 0. Rows that tie are numbered in any way."""
    rows = _ranged(df, order, range_rows)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = _before(sizes, {"n": (F.col("__n"), F.sum("__n"))})
    numbered = rows.join(F.broadcast(offsets), F.col("__range") == F.col("__of"))  # a row a range
    return numbered.select(*df.columns, (F.coalesce("__before_n", F.lit(0)) + F.col("__seq")).cast("long").alias(name))


def running_totals_in_order(df: DataFrame, order: Sequence[Column], totals: Mapping[str, tuple[str, str]], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with totals over all rows up to each row: name -> (sum, count, min or max, column).

    As a window's frame of rows from the first to the current one; the order should be total.
    """
    step = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    onward = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    rows = _ranged(df, order, range_rows)
    sums = rows.groupBy("__range").agg(*[step[kind](column).alias(f"__part_{name}") for name, (kind, column) in totals.items()])
    offsets = _before(sums, {name: (F.col(f"__part_{name}"), onward[kind](f"__part_{name}")) for name, (kind, _) in totals.items()})
    inside = Window.partitionBy("__range").orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.select("*", *[step[kind](column).over(inside).alias(f"__in_{name}") for name, (kind, column) in totals.items()])
    joined = scanned.join(F.broadcast(offsets), F.col("__range") == F.col("__of"))

    def total(name: str, kind: str) -> Column:
        a, b = F.col(f"__before_{name}"), F.col(f"__in_{name}")
        both = {"sum": a + b, "count": a + b, "min": F.least(a, b), "max": F.greatest(a, b)}[kind]
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both).alias(name)

    return joined.select(*df.columns, *[total(name, kind) for name, (kind, _) in totals.items()])


def ranks_in_order(df: DataFrame, by: Sequence[tuple[str, str]], rank: str | None = None, dense: str | None = None, percent: str | None = None, cumulative: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with rank, dense rank, percent rank and cumulative share over the whole table, under the names given.

    ``by``: columns, each with one of asc_nulls_first, asc_nulls_last, desc_nulls_first
    and desc_nulls_last. Equal values, nulls too, count as one row when ranges are
    dealt, and get their ranks back by a join that splits frequent values.
    """
    columns = [c for c, _ in by]
    order = [getattr(F.col(c), way)() for c, way in by]
    values = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__rows")).withColumn("__one", F.lit(1))
    scanned = running_totals_in_order(values, order, {"__upto": ("sum", "__rows"), "__distinct": ("sum", "__one")}, range_rows)
    ranked = scanned.select(*[F.col(c).alias(f"__key_{i}") for i, c in enumerate(columns)], "__upto", "__distinct", (F.col("__upto") - F.col("__rows") + 1).alias("__rank"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__key_{i}")) for i, c in enumerate(columns)])
    joined = df.join(ranked, same)
    if percent or cumulative:
        joined = joined.withColumn("__all", F.lit(df.count()))
    found = {
        rank: F.col("__rank").cast("long"),
        dense: F.col("__distinct").cast("long"),
        percent: F.when(F.col("__all") > 1, (F.col("__rank") - 1) / (F.col("__all") - 1)).otherwise(F.lit(0.0)) if percent else None,
        cumulative: F.col("__upto") / F.col("__all") if cumulative else None,
    }
    return joined.select(*df.columns, *[c.alias(n) for n, c in found.items() if n])
