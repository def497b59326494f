"""Running results by key over a stream, kept in state: in the JVM where an aggregate will do, in Python where none does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_totals(events: DataFrame) -> DataFrame:
    """user_id with events and value so far, each time the user has new events. For update mode."""
    kept = events.where(F.col("user_id").isNotNull())
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def smoothed_levels(events: DataFrame, weight: float = 0.3) -> DataFrame:
    """user_id and the exponentially smoothed value, each time the user has new events. For update mode.

    Events of one batch count in order of their time; what came in earlier batches counts as before them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (level,) = state.get if state.exists else (None,)
        rows = pd.concat(list(batches)).sort_values("ts")
        for value in rows["value"]:
            level = float(value) if level is None else weight * float(value) + (1 - weight) * level
        state.update((level,))
        yield pd.DataFrame({"user_id": [key[0]], "level": [level]})

    kept = events.where(F.col("user_id").isNotNull() & F.col("value").isNotNull()).select("user_id", "ts", "value")
    return kept.groupBy("user_id").applyInPandasWithState(run, "user_id long, level double", "level double", "update", GroupStateTimeout.NoTimeout)


class Gaps(StatefulProcessor):
    """The longest time a key has been silent, told whenever it grows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp")
        self.longest = handle.getValueState("longest", "seconds double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        times = pd.concat(list(rows))["ts"].sort_values()
        last, longest = self.last.get(), self.longest.get()
        before = longest[0] if longest else 0.0
        now = before
        known = [pd.Timestamp(last[0])] if last else []
        for a, b in zip([*known, *times], [*known, *times][1:], strict=False):
            now = max(now, (b - a).total_seconds())
        self.last.update((max([*known, times.max()]).to_pydatetime(),))
        if now > before:
            self.longest.update((now,))
            yield pd.DataFrame({"user_id": [key[0]], "seconds": [now]})

    def close(self) -> None:
        pass


def longest_gaps(events: DataFrame) -> DataFrame:
    """user_id and the longest gap between its events in seconds, whenever it grows. Needs RocksDB as the state store."""
    kept = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("user_id", "ts")
    return kept.groupBy("user_id").transformWithStateInPandas(Gaps(), "user_id long, seconds double", "Update", "none")


def first_of_each(events: DataFrame, key: str) -> DataFrame:
    """The first row of each key within the watermark; later ones are dropped."""
    return events.dropDuplicatesWithinWatermark([key])
