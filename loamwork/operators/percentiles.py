"""Exact percentiles by group, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, row_numbers
from .stages import staged


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Percentiles (name -> share) of each group's values that are not null, between two values in proportion.

    Rows are numbered in the order of group and value, over ranges that may cut a
    group anywhere, so a group of any size, and the whole table as one, is spread over
    tasks. A group's rows have consecutive numbers; those next to its percentiles are
    looked up. A group without values has no row. Group columns may be null.
    """
    values = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("__value"))
    keys = [f"__by_{i}" for i in range(len(by))]
    numbered = staged(row_numbers(values, [F.col(c) for c in (*keys, "__value")], "__at", range_rows), "numbered").df
    groups = numbered.groupBy(*keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 0")
    exact = {name: (F.col("__n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    ends = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.col("__first") + f(x)).alias("at"), (x - F.floor(x)).alias("part")) for name, x in exact.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    wanted = groups.select(*keys, F.explode(ends).alias("w")).select(*keys, "w.*")
    met = wanted.join(numbered.select(F.col("__at").alias("at"), "__value"), "at")
    pick = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("__value")))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    found = met.groupBy(*keys).agg(*[(pick(n, "low") + (pick(n, "high") - pick(n, "low")) * part(n)).alias(n) for n in shares])
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *shares)


def exact_percentile(df: DataFrame, by: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """One percentile of each group."""
    return exact_percentiles(df, by, value, {name: share})
