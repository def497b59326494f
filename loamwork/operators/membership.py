"""NOT IN between tables, by the rules of SQL for nulls, without a broadcast that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows of ``df`` for which ``column NOT IN (values)`` is true.

    With a null among the values no row is; with no values every row is, a null too;
    else a null is not. Spark's own null-aware anti join broadcasts the values whatever
    their number; here the two questions are asked first and the rest is a plain anti
    join, for which Spark may choose any strategy.
    """
    wanted = values.select(F.col(value).alias("__value"))
    if not wanted.where("__value is null").isEmpty():
        return df.limit(0)
    if wanted.isEmpty():
        return df
    return df.where(F.col(column).isNotNull()).join(wanted, F.col(column) == F.col("__value"), "left_anti")
