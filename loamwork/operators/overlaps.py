"""Join of two sides of intervals that overlap, without a nested loop and without a width to choose.

An interval's level is that of its length, so it touches a few bins of its level, and
goes to the bins it touches on every coarser level that is in use, one or two each.
Two intervals meet on the coarser of their two levels, where one of them fills most of
the bins it touches: pairs that are tried and do not overlap are only those at its
ends. Of the bins that both touch, the one where the later of them begins reports them.

Bins copy an interval several times. Where columns must agree and a key of theirs has
few rows, it is cheaper to try these with each other: such keys are joined by Spark on
the columns alone, and only the keys with many rows go to bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hotkeys import BROADCAST_ROWS, CELL_ROWS, KINDS, TASK_ROWS, hot_key_join
from .inequalities import join_of_pairs
from .ranges import SPREAD, number_of
from .stages import staged

#: Rows that a key has on either side at most to be joined without bins; so a row is tried with no more than these.
KEY_ROWS = 1 << 8


def _levelled(side: DataFrame, begin: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """id, b, e, level and keys of the intervals that are not empty and whose keys are not null."""
    rows = side.where(F.col(begin) < F.col(end)).dropna(subset=list(keys) or [begin])
    rows = rows.select(F.col("__id").alias("id"), number_of(side, begin).alias("b"), number_of(side, end).alias("e"), F.struct(F.lit(0).alias("k"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("keys"))
    return rows.where("b < e").withColumn("level", F.ceil(F.log(float(SPREAD), (F.col("e") - F.col("b")) / SPREAD)).cast("int"))


def _binned(rows: DataFrame, prefix: str, levels: Column) -> DataFrame:
    """A row for each bin that an interval touches on each of ``levels``; its end is not part of it."""
    wide = rows.withColumn("at_level", F.explode(levels.cast("array<int>")))  # one type on both sides: a key that has to be cast is shuffled again
    width = F.pow(F.lit(float(SPREAD)), F.col("at_level"))
    first, last = F.floor(F.col("b") / width).cast("long"), F.ceil(F.col("e") / width).cast("long") - 1
    binned = wide.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
    return binned.select(F.struct(F.col("at_level").alias("level"), "bin", "keys").alias(f"{prefix}_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "b", "e")])


def overlapping_pairs(left: DataFrame, right: DataFrame, left_begin: str, left_end: str, right_begin: str, right_end: str, on: Sequence[tuple[str, str]] = (), cell_rows: int = CELL_ROWS) -> DataFrame:
    """left_id, right_id of the pairs that share a point and agree in the columns ``on``; both sides have a unique long ``__id``."""
    a, b = (staged(_levelled(side, begin, end, [pair[i] for pair in on]), "levelled").df for i, (side, begin, end) in enumerate(((left, left_begin, left_end), (right, right_begin, right_end))))
    used = lambda rows: {r[0] for r in rows.select("level").distinct().collect()}  # noqa: E731  (a logarithm of the lengths)
    in_a, in_b = sorted(used(a)), sorted(used(b))
    among = lambda levels, test: F.filter(F.array(*[F.lit(x) for x in levels]), test) if levels else F.array().cast("array<int>")
    own = F.array("level")
    # what the left side's level decides, with the right one as fine or finer; then the rest
    met = [
        (_binned(a, "l", own), _binned(b, "r", among(in_a, lambda x: x >= F.col("level")))),
        (_binned(a, "l", among(in_b, lambda x: x > F.col("level"))), _binned(b, "r", own)),
    ]
    here = F.floor(F.greatest("l_b", "r_b") / F.pow(F.lit(float(SPREAD)), F.col("l_key.level"))).cast("long") == F.col("l_key.bin")
    both = (F.col("l_b") < F.col("r_e")) & (F.col("r_b") < F.col("l_e"))
    one, two = (hot_key_join(x, y, "l_key", "r_key", "inner", cell_rows).where(both & here).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")) for x, y in met)
    return one.unionAll(two)


def _heavy_keys(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], key_rows: int) -> DataFrame:
    """__k0, __k1, ...: the values of the columns ``on`` that more than ``key_rows`` rows have on a side."""

    def of(side: DataFrame, i: int) -> DataFrame:
        keys = side.dropna(subset=[pair[i] for pair in on]).select(*[F.col(pair[i]).alias(f"__k{n}") for n, pair in enumerate(on)])
        return keys.groupBy(*keys.columns).count().where(F.col("count") > key_rows).drop("count")

    return of(left, 0).unionAll(of(right, 1))


def _joined_by_key(left: DataFrame, right: DataFrame, left_begin: str, left_end: str, right_begin: str, right_end: str, on: Sequence[tuple[str, str]], also: Column | None, how: str, tasks: int) -> DataFrame:
    """The join on the columns ``on``, which tries a row with all that have its key; ``tasks`` 0 leaves their number to Spark. Rows that can match nothing are not shuffled."""

    def marked(side: DataFrame, begin: str, end: str, i: int) -> DataFrame:
        rows = side.withColumns({f"__b{i}": number_of(side, begin), f"__e{i}": number_of(side, end)})
        fit = [F.col(begin) < F.col(end), F.col(f"__b{i}") < F.col(f"__e{i}"), *[F.col(pair[i]).isNotNull() for pair in on]]
        return rows.withColumn(f"__some{i}", F.coalesce(reduce(lambda x, y: x & y, fit), F.lit(False)))

    def some(rows: DataFrame, i: int) -> DataFrame:
        rows = rows.where(f"__some{i}")
        return (rows.repartition(tasks, *[pair[i] for pair in on]) if tasks > 1 else rows).hint("merge")

    def alone(rows: DataFrame, i: int) -> DataFrame:
        return rows.where(f"not __some{i}")

    nulls = lambda side: [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema]
    columns = list(left.columns) if how in ("left_semi", "left_anti") else [*left.columns, *right.columns]
    a, b = marked(left, left_begin, left_end, 0), marked(right, right_begin, right_end, 1)
    met = [F.col(x) == F.col(y) for x, y in on] + [F.col("__b0") < F.col("__e1"), F.col("__b1") < F.col("__e0")] + ([] if also is None else [also])
    found = [some(a, 0).join(some(b, 1), reduce(lambda x, y: x & y, met), how).select(*columns)]
    if how == "left_anti":
        found.append(alone(a, 0).select(*columns))
    if how in ("left", "full"):
        found.append(alone(a, 0).select(*left.columns, *nulls(right)))
    if how in ("right", "full"):
        found.append(alone(b, 1).select(*nulls(left), *right.columns))
    return reduce(DataFrame.unionAll, found)


def overlap_join(
    left: DataFrame, right: DataFrame, left_begin: str, left_end: str, right_begin: str, right_end: str, on: Sequence[tuple[str, str]] = (), also: Column | None = None, how: str = "inner", cell_rows: int = CELL_ROWS, key_rows: int = KEY_ROWS
) -> DataFrame:
    """Pairs of intervals, begin included and end not, that share a point, agree in the pairs of columns ``on``, and for which ``also`` holds.

    Columns of ``on`` have one type on both sides; a null there matches nothing. ``how`` is inner, left, right, full, left_semi or left_anti. Column names must
    differ between the sides. Numbers, dates and timestamps will do, compared as doubles
    (timestamps to the microsecond); intervals with a null or with no length match nothing. Rows whose key in ``on``
    has no more than ``key_rows`` rows on either side meet by the key, all others by bins. A bin that very many
    intervals touch is split like any hot key.
    """
    if how not in KINDS:
        raise ValueError(f"no overlap join of kind {how}")
    a, b = (staged(side.withColumn("__id", F.monotonically_increasing_id()), "side").df for side in (left, right))
    ends = (left_begin, left_end, right_begin, right_end)
    by_bins = lambda x, y: join_of_pairs(x, y, overlapping_pairs(x, y, *ends, on, cell_rows), also, how)
    if not on:
        return by_bins(a, b)
    tasks = (a.count() + b.count()) // TASK_ROWS
    by_key = lambda x, y: _joined_by_key(x.drop("__id"), y.drop("__id"), *ends, on, also, how, tasks)
    heavy = staged(_heavy_keys(a, b, on, key_rows), "heavy-keys").df
    many = heavy.count()
    if not many:
        return by_key(a, b)
    heavy = heavy.hint("broadcast" if many <= BROADCAST_ROWS else "merge")

    def of(side: DataFrame, i: int, kind: str) -> DataFrame:
        return side.join(heavy, reduce(lambda x, y: x & y, [F.col(pair[i]) == F.col(f"__k{n}") for n, pair in enumerate(on)]), kind)

    return by_key(of(a, 0, "left_anti"), of(b, 1, "left_anti")).unionAll(by_bins(of(a, 0, "left_semi"), of(b, 1, "left_semi")))
