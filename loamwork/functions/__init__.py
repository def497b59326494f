"""Column functions whose meaning does not change from engine to engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(at: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(at) - 1).cast("long")


def concat_skipping_nulls(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def substring_from(text: Column, start: int, length: int) -> Column:
    """The characters from place ``start`` on, where 1 is the first, 0 is before it and -1 is the last; what lies outside is empty."""
    if start > 0:
        return F.substring(text, start, length)
    if start == 0:
        return F.substring(text, 1, max(length - 1, 0))
    outside = F.greatest(F.lit(-start) - F.length(text), F.lit(0))  # what the text lacks before its first character
    return F.substr(text, F.greatest(F.length(text) + start, F.lit(0)) + 1, F.greatest(F.lit(length) - outside, F.lit(0)))


def divide_or_null(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sample_skewness(x: Column) -> Column:
    """Skewness adjusted for the sample's size, as most engines define it."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays of one length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
