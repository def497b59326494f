"""Alerts on silence and joins of two streams: results that need event-time timers or time-bounded state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Stands for no last event.
_NONE = -(1 << 62)
_DAY = 86_400_000_000
_START = dt.datetime(1970, 1, 1)
_MICROSECOND = dt.timedelta(microseconds=1)

#: Settings for the stream of a join (see replay): all its state of a task in one store, not four, whose writes don't read first to keep a count of rows.
JOIN_STATE = {"spark_sql_streaming_join_stateFormatVersion": "3", "spark_sql_streaming_stateStore_rocksdb_trackTotalNumberOfRows": "false"}


class Silence(StatefulProcessor):
    """Tells of each time a key was silent for longer than a limit, as soon as that is known.

    Of two events in one batch the gap is seen at once; after a key's last event a
    timer is set, which the watermark lets expire. Recent event ids, kept for as long
    as a repeat may come, leave out events met again; a key's alerts are counted by
    day. All of it is one value, read and written once for a key's rows of a batch, as
    each call to the state store costs about as much as some hundred rows. Rows come one
    by one, as most keys have few in a batch and a data frame for each costs more than
    they do. Times are in microseconds, as the session's clocks show them.
    """

    def __init__(self, seconds: float) -> None:
        self.limit = round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last long, events array<long>, at array<long>, days array<int>, told array<int>")

    def _load(self) -> tuple[int, dict[int, int], dict[int, int]]:
        last, events, at, days, told = self.known.get() or (_NONE, [], [], [], [])
        return last, dict(zip(events, at, strict=True)), dict(zip(days, told, strict=True))

    def _save(self, last: int, seen: dict[int, int], told: dict[int, int]) -> None:
        self.known.update((last, list(seen), list(seen.values()), list(told), list(told.values())))

    def _timer(self, last: int) -> int:
        return (last + self.limit) // 1000

    @staticmethod
    def _alert(since: int, told: dict[int, int]) -> tuple[int, int]:
        told[since // _DAY] = told.get(since // _DAY, 0) + 1
        return since, told[since // _DAY]

    @staticmethod
    def _row(key: tuple, since: int, of_day: int) -> Row:
        return Row(user_id=key[0], silent_since=_START + dt.timedelta(microseconds=since), of_day=of_day)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, seen, told = self._load()
        events = [((ts.replace(tzinfo=None) - _START) // _MICROSECOND, event) for event, _, ts in rows]
        last, found = known, []
        for at, event in sorted(events, key=itemgetter(0)):
            if event in seen:
                continue
            if event is not None:  # without an id each counts
                seen[event] = at
            if last != _NONE and at - last > self.limit:
                found.append(self._alert(last, told))
            last = max(last, at)
        if last > known:
            if known != _NONE:
                self.handle.deleteTimer(self._timer(known))
            self.handle.registerTimer(self._timer(last))
        if last != _NONE:  # else all were met before
            seen = {event: at for event, at in seen.items() if last - at <= self.limit}
        self._save(last, seen, told)
        for since, of_day in found:
            yield self._row(key, since, of_day)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, seen, told = self._load()
        since, of_day = self._alert(last, told)
        self._save(_NONE, seen, told)  # a next event begins anew: this silence is told
        yield self._row(key, since, of_day)

    def close(self) -> None:
        pass


def silence_alerts(events: DataFrame, seconds: float) -> DataFrame:
    """user_id, silent_since, of_day (the how manieth of that day) for each silence longer than ``seconds``. Needs a watermark on ts and RocksDB as the state store."""
    kept = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("event_id", "user_id", "ts")
    told = kept.groupBy("user_id").transformWithState(Silence(seconds), "user_id long, silent_since timestamp_ntz, of_day int", "Append", "eventTime")
    return told.withColumn("silent_since", F.col("silent_since").cast("timestamp"))


def followed_by(events: DataFrame, first: str, then: str, within: str) -> DataFrame:
    """user_id, first_id, then_id: events of one type that one of another follows within a time, as a join of two streams.

    Both sides keep their rows in state no longer than the watermark and ``within`` ask for. A row is
    tried with all that state holds under its key, so the key has the time as well as the user: a
    first event goes to one span, the other to its own span and the one before. A span is no shorter
    than ``within``, also where its months or days are longer than those after 1970-01-01.
    """
    span = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {within})") * 1.1 + 7_200_000_000
    span_of = lambda at: F.floor(F.unix_micros(at) / span)
    a = events.where(F.col("event_type") == first).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_at"), span_of("ts").alias("first_span"))
    b = events.where(F.col("event_type") == then).select(F.col("user_id").alias("then_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_at"), span_of("ts").alias("last_span"))
    b = b.select("then_user", "then_id", "then_at", F.explode(F.array(F.col("last_span") - 1, "last_span")).alias("then_span"))
    met = a.join(b, F.expr(f"user_id = then_user AND first_span = then_span AND then_at > first_at AND then_at <= first_at + INTERVAL {within}"))
    return met.select("user_id", "first_id", "then_id")
