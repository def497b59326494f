"""Range join: points with the intervals that hold them, by equi-join on bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of one level that an interval may touch, about; a longer one goes to a coarser level.
SPREAD = 8


def number_of(df: DataFrame, x: str) -> Column:
    """Numbers as they are, times in seconds."""
    times = ("timestamp", "timestamp_ntz", "date")
    return F.unix_micros(F.col(x).cast("timestamp")) / 1e6 if dict(df.dtypes)[x] in times else F.col(x).cast("double")


def range_join(points: DataFrame, intervals: DataFrame, at: str, begin: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Rows with begin <= at < end; ``how`` is inner, left, left_semi or left_anti, where points are left.

    Each interval goes to the bins of ``width`` it touches and each point to its
    own, so a pair meets in one bin only and neither duplicates nor a nested loop
    arise. ``width`` should be near the usual length of an interval; one much
    longer goes to bins ``SPREAD`` times as wide, or that again, so it never
    touches more than ``SPREAD`` + 1. There are as many joins as there are levels in
    use. Column names must differ between the sides. Numbers and timestamps will do
    for the columns; rows with nulls there, and intervals that end before they
    begin, match nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no range join of kind {how}")
    span = (number_of(intervals, end) - number_of(intervals, begin)) / F.lit(float(width))
    level = F.greatest(F.ceil(F.log(float(SPREAD), span / SPREAD)), F.lit(0)).cast("int")
    levelled = intervals.where(F.col(begin) < F.col(end)).withColumn("__level", level)
    used = sorted(r[0] for r in levelled.select("__level").distinct().collect())  # a logarithm of the longest
    columns = [*points.columns, *intervals.columns]

    def joined(rows: DataFrame, step: int, kind: str) -> DataFrame:
        bin_of = lambda x: F.floor(x / F.lit(float(width) * SPREAD**step)).cast("long")
        own = levelled.where(F.col("__level") == step).drop("__level")
        bins = own.withColumn("__bin", F.explode(F.sequence(bin_of(number_of(intervals, begin)), bin_of(number_of(intervals, end)))))
        keyed = rows.withColumn("__at_bin", bin_of(number_of(points, at)))
        inside = (F.col("__at_bin") == F.col("__bin")) & (F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))
        return keyed.join(bins, inside, kind).drop("__bin", "__at_bin")

    rest = points
    found: list[DataFrame] = []
    for step in used:
        if how in ("inner", "left"):
            found.append(joined(points, step, "inner").select(*columns))
        elif how == "left_semi":
            found.append(joined(rest, step, "left_semi"))
        if how != "inner":
            rest = joined(rest, step, "left_anti")
    if how == "left_anti":
        return rest
    if how == "left":
        found.append(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in intervals.schema]))
    if not found:
        return points.limit(0) if how == "left_semi" else points.crossJoin(intervals.limit(0))
    return reduce(DataFrame.union, found)
