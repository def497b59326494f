"""Sessions: runs of events of one key with no longer gap than given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import time_bucket


def sessionize(events: DataFrame, by: Sequence[str], at: str, gap_seconds: float, tie: Sequence[str] = (), every: float | None = None) -> DataFrame:
    """``events`` with session_no, from 1 for each key. An event exactly one gap later still belongs.

    With ``every`` (seconds) the time of a key is cut into buckets, which hand on
    their last time and number of sessions, so a key with very many events is
    spread over as many tasks as it has buckets. Null keys are a key like any other;
    events without a time come first and open no session.
    """
    bucket = F.lit(0).cast("long") if every is None else time_bucket(F.col(at), every, "timestamp")
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    rows = events.select("*", bucket.alias("__bucket"), seconds.alias("__at"))
    order = Window.partitionBy(*by, "__bucket").orderBy(F.col(at).asc_nulls_first(), *tie)
    opens = F.coalesce((F.col("__at") - F.lag("__at").over(order) > F.lit(gap_seconds)).cast("int"), F.lit(0))
    marked = rows.withColumn("__opens", opens)
    so_far = F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = marked.withColumn("__no", so_far)
    if every is None:
        return numbered.select(*events.columns, (F.col("__no") + 1).alias("session_no"))
    ordered = Window.partitionBy(*by).orderBy(F.col("__bucket").asc_nulls_first())
    buckets = marked.groupBy(*by, "__bucket").agg(F.min("__at").alias("__first"), F.max("__at").alias("__end"), F.sum("__opens").alias("__inner"))
    begins = F.coalesce((F.col("__first") - F.lag("__end").over(ordered) > F.lit(gap_seconds)).cast("int"), F.lit(0))
    handed = (
        buckets.withColumn("__begins", begins)
        .withColumn("__before", F.coalesce(F.sum(F.col("__inner") + F.col("__begins")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__bucket").alias("__in"), (F.col("__before") + F.col("__begins")).alias("__handed"))
    )
    same = F.col("__bucket").eqNullSafe(F.col("__in"))
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return numbered.join(handed, same).select(*events.columns, (F.col("__no") + F.col("__handed") + 1).alias("session_no"))
