"""As-of join: each left row with the latest right row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(at: Column, every: float, kind: str) -> Column:
    """The number of the bucket of ``every`` (seconds, for times) that a time or number falls into."""
    number = F.unix_micros(at.cast("timestamp")) / 1e6 if kind in ("timestamp", "timestamp_ntz", "date") else at.cast("double")
    return F.floor(number / F.lit(float(every))).cast("long")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, right_on: str, carry: Sequence[str], strict: bool = False, every: float | None = None
) -> DataFrame:
    """All columns of ``left`` and, of the latest right row, its time and the columns in ``carry``.

    Both sides are laid over each other and a window carries right rows forward, so
    no pairs are made. With ``every``, the time of a key is cut into buckets of that
    length (seconds, for times): windows then are of one key and bucket, and what
    buckets hand on is their last right row, so a key with very many rows is spread
    over as many tasks as it has buckets. Right rows with equal times and keys go by
    the greatest of their carried values; with ``strict`` only times before the left
    row's count. A left row without a match has nulls; null keys match nothing.
    """
    taken = F.struct(F.col(right_on).alias(right_on), *carry)
    keyed = reduce(lambda a, key: a & F.col(key).isNotNull(), by, F.lit(True))
    kind = dict(left.dtypes)[on]
    lefts = left.select(F.struct("*").alias("__row"), *by, F.col(on).alias("__at"), F.lit(None).cast(right.select(taken).schema[0].dataType).alias("__got"))
    rights = right.where(keyed).select(F.lit(None).cast(lefts.schema["__row"].dataType).alias("__row"), *by, F.col(right_on).alias("__at"), taken.alias("__got"))
    left_first = F.col("__got").isNotNull() if strict else F.col("__got").isNull()
    bucket = F.lit(0).cast("long") if every is None else time_bucket(F.col("__at"), every, kind)
    laid = lefts.unionByName(rights).withColumn("__bucket", bucket)
    order = Window.partitionBy(*by, "__bucket").orderBy(F.col("__at").asc_nulls_first(), left_first, F.col("__got").asc_nulls_first())
    last = F.last("__got", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = laid.withColumn("__last", last).where(F.col("__row").isNotNull())
    if every is not None:
        before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        newest = laid.where(keyed & F.col("__at").isNotNull()).groupBy(*by, "__bucket").agg(F.max(F.when(F.col("__got").isNotNull(), F.struct("__at", "__got"))).alias("__newest"))
        handed = newest.withColumn("__handed", F.last("__newest", ignorenulls=True).over(before)["__got"])
        handed = handed.where("__handed is not null").select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__bucket").alias("__in"), "__handed")
        same = reduce(lambda a, k: a & (F.col(k) == F.col(f"__{k}")), by, F.col("__bucket") == F.col("__in"))
        found = found.join(handed, same, "left").withColumn("__last", F.coalesce("__last", "__handed"))
    got = F.when(keyed & F.col("__at").isNotNull(), F.col("__last"))
    return found.withColumn("__last", got).select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in (right_on, *carry)])
