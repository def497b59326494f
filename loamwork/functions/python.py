"""Functions that run in Python, for what built-in functions lack: over Arrow batches, by group, and as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def luhn_digit(numbers: pd.Series) -> pd.Series:
    """The check digit that makes a number with it at the end pass the Luhn test. Null stays null."""
    left = numbers.fillna(0).to_numpy(dtype=np.int64)
    total, double = np.zeros(len(left), dtype=np.int64), True
    while left.any():
        left, digit = np.divmod(left, 10)
        twice = 2 * digit
        total += np.where(double, twice // 10 + twice % 10, digit)
        double = not double
    return pd.Series(-total % 10, index=numbers.index).where(numbers.notna()).astype("Int64")


def smoothed(df: DataFrame, by: str, at: str, value: str, weight: float) -> DataFrame:
    """by and level: the exponentially smoothed value at each group's last row, in order of ``at``.

    A group is one table in a task, so groups should be of bounded size.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        levels = group.sort_values(at)[value].astype(float).ewm(alpha=weight, adjust=False).mean()
        return pd.DataFrame({by: [group[by].iloc[0]], "level": [levels.iloc[-1]]})

    kind = df.schema[by].dataType.simpleString()
    return df.select(*dict.fromkeys([by, at, value])).where(F.col(value).isNotNull()).groupBy(by).applyInPandas(run, f"{by} {kind}, level double")


@F.udtf(returnType="tile bigint")
class Tiles:
    """A row for each step from a number on, below an end."""

    def eval(self, start: int, end: int, step: int) -> Iterator[tuple[int]]:
        for tile in range(start, end, step):
            yield (tile,)
