"""Streaming queries: the event table arrives in parts, the stream is run to its end, and its results are held against SQL over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from ..streaming import JOIN_STATE, arriving, first_of_each, followed_by, last_of_each, replay, running_totals, session_totals, silence_alerts, windowed_totals
from .relational import query

#: Parts in which events arrive: by eight days, and a tenth of them one part late.
PARTS = 4
_LATE = "least(3, (day(ts) - 1) {div} 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"
_IN_ORDER = "least(3, (day(ts) - 1) {div} 8)"
_PARTS_SQL = f"""
        e AS (SELECT *, {_LATE.format(div="//")} AS part FROM events),
        marks AS (SELECT part + 1 AS part, max(max(ts)) OVER (ORDER BY part) - INTERVAL 10 MINUTE AS mark FROM e GROUP BY part),
        final AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def marked(stream: DataFrame) -> DataFrame:
    return stream.withWatermark("ts", "10 minutes")


def parts_of(spark: SparkSession, sf_dir: str, rule: str) -> list[DataFrame]:
    return arriving(events(spark, sf_dir), F.expr(rule.format(div="div")), PARTS)


@query(f"""
    WITH {_PARTS_SQL}, kept AS (
        SELECT e.*, date_trunc('hour', ts) AS w FROM e LEFT JOIN marks USING (part)
        WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark
    )
    SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM kept, final
    WHERE w + INTERVAL 1 HOUR <= mark GROUP BY w, event_type
""")
def stream_windows_and_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: closed windows only, and rows that come after their window has closed are dropped."""
    found = replay(parts_of(spark, sf_dir, _LATE), lambda s: windowed_totals(marked(s), "1 hour"))
    return found.drop("__batch")


@query("""
    WITH final AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), starts AS (
        SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR, time_bucket(INTERVAL 3 HOUR, ts)]) AS w, event_type, value FROM events
    )
    SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM starts, final WHERE w + INTERVAL 6 HOUR <= mark GROUP BY w, event_type
""")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replay(parts_of(spark, sf_dir, _IN_ORDER), lambda s: windowed_totals(marked(s), "6 hours", "3 hours"))
    return found.drop("__batch")


@query("""
    WITH final AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), steps AS (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events
    ), numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM steps)
    SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 2) AS total FROM numbered, final
    GROUP BY user_id, session, mark HAVING max(ts) + INTERVAL 2 HOUR <= mark
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replay(parts_of(spark, sf_dir, _IN_ORDER), lambda s: session_totals(marked(s), "2 hours"))
    return found.drop("__batch")


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: a key's last row is its total over all parts."""
    found = replay(parts_of(spark, sf_dir, _LATE), running_totals, "update")
    return last_of_each(found, ["user_id"]).withColumn("total", F.round("total", 2))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event arrives twice, every fifth also in the next part: the first one counts."""
    at, rows = F.expr(_IN_ORDER.format(div="div")), events(spark, sf_dir)
    parts = [rows.where(at == i).union(rows.where(at == i)).union(rows.where((at == i - 1) & (F.col("event_id") % 5 == 0))) for i in range(PARTS)]
    found = replay(parts, lambda s: first_of_each(s.withWatermark("ts", "40 days"), "event_id").select("event_type"))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
""")
def stream_join_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined with another within a time: each keeps rows only as long as one may still match."""
    found = replay(parts_of(spark, sf_dir, _IN_ORDER), lambda s: followed_by(marked(s), "view", "purchase", "6 HOURS"), **JOIN_STATE)
    return found.drop("__batch")


@query("""
    WITH final AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
    gaps AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
    SELECT user_id, ts AS silent_since FROM gaps, final WHERE next - ts > INTERVAL 24 HOUR OR (next IS NULL AND date_trunc('milliseconds', ts) + INTERVAL 24 HOUR <= mark)
""")
def stream_silence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers: a user's silence is told when the watermark passes its end, or when the next event comes."""
    found = replay(parts_of(spark, sf_dir, _IN_ORDER), lambda s: silence_alerts(marked(s), 24 * 3600))
    return found.select("user_id", F.col("silent_since").cast("timestamp_ntz").alias("silent_since"))
