"""Aggregates written in Python with a partial and a final step, as Spark's own have.

Tasks reduce the rows they read to one state a group before anything is shuffled; states
are merged in two steps, first some of a group's, then what is left. So a group may
hold any share of the rows: what meets in one task is states, and a few of them.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups a task holds states of; then it hands on what it has and goes on without.
MOST_STATES = 50_000

#: Parts in which a group's states are merged first.
PARTS = 64


class PartialAggregate(ABC):
    """An aggregate whose states can be merged in any order. States and results are tuples, as the schemas say."""

    state: str
    result: str

    @abstractmethod
    def partial(self, rows: pd.DataFrame) -> tuple:
        """The state of some rows of one group, without its key columns."""

    @abstractmethod
    def merge(self, states: pd.DataFrame) -> tuple:
        """One state for some of a group's."""

    @abstractmethod
    def finish(self, state: tuple) -> tuple:
        """The result of a group."""


def aggregate_in_python(df: DataFrame, by: Sequence[str], values: Sequence[str], aggregate: PartialAggregate, most_states: int = MOST_STATES) -> DataFrame:
    """A row a group: columns ``by``, whose nulls are a group, and those of ``aggregate.result``."""
    by, values = list(by), list(values)
    schema = lambda columns: ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], columns])
    names = [part.split()[0] for part in aggregate.state.split(", ")]
    ends = [part.split()[0] for part in aggregate.result.split(", ")]

    def table(groups: list[tuple], columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame(groups, columns=[*by, *columns], dtype=object)

    def grouped(frame: pd.DataFrame, make, columns: list[str]) -> pd.DataFrame:
        made = frame.groupby(by, dropna=False, sort=False)
        return table([(*[None if pd.isna(k) else k for k in key], *make(rows.drop(columns=by))) for key, rows in made], columns)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch):
                held.append(grouped(batch, aggregate.partial, names))
            if sum(map(len, held)) > most_states:
                merged = grouped(pd.concat(held), aggregate.merge, names)
                held = [merged]
                if len(merged) > most_states // 2:
                    yield merged
                    held = []
        if held:
            yield grouped(pd.concat(held), aggregate.merge, names)

    def one(group: pd.DataFrame, make, columns: list[str]) -> pd.DataFrame:
        key = [None if pd.isna(group[c].iloc[0]) else group[c].iloc[0] for c in by]
        return table([(*key, *make(group[names]))], columns)

    states = df.select(*by, *values).mapInPandas(partials, schema(aggregate.state)).withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = states.groupBy(*by, "__part").applyInPandas(lambda g: one(g, aggregate.merge, names), schema(aggregate.state))
    return some.groupBy(*by).applyInPandas(lambda g: one(g, lambda s: aggregate.finish(aggregate.merge(s)), ends), schema(aggregate.result))


class MinHash(PartialAggregate):
    """The signature of a group's set of whole numbers: for each of ``size`` functions the least value of it, or null for no number.

    Function i maps x to ((2 i + 1) * 40503 * x + 7919 * i) mod 65521; the share of
    places in which two signatures agree estimates how similar their sets are.
    """

    state = "minima array<bigint>"
    result = "signature array<bigint>"

    def __init__(self, column: str, size: int) -> None:
        self.column, self.places = column, np.arange(size, dtype=np.int64)

    def partial(self, rows: pd.DataFrame) -> tuple:
        x = rows[self.column].dropna().to_numpy(dtype=np.int64) % 65521
        if not len(x):
            return (None,)
        factor = (2 * self.places + 1) * 40503 % 65521
        return (((factor[:, None] * np.unique(x)[None, :] + 7919 * self.places[:, None]) % 65521).min(axis=1).tolist(),)

    def merge(self, states: pd.DataFrame) -> tuple:
        there = [np.asarray(s, dtype=np.int64) for s in states["minima"] if s is not None]
        return (np.min(there, axis=0).tolist(),) if there else (None,)

    def finish(self, state: tuple) -> tuple:
        return state
