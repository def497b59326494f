"""Rank over a whole table, without a window that holds it all."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ordered import RANGE_ROWS, ranks_in_order


def global_rank(df: DataFrame, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """``df`` with the rank of each row by a value, greatest first, nulls last, equal values alike; over about so many ranges, if ``buckets`` is given."""
    rows = RANGE_ROWS if buckets is None else max(1, -(-df.count() // buckets))
    return ranks_in_order(df, [(value, "desc_nulls_last")], rank=name, range_rows=rows)
