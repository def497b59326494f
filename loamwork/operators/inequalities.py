"""Joins of two large sides on inequalities, without a nested loop.

The values that an inequality compares are numbered in one order over both sides, so
that it says that the left number is below the right one. Two numbers differ first
at one bit, where the left one has 0 and the right one 1: a pair meets under the
bits above it and nowhere else. So each row goes to as many keys as its number has
bits of its side's kind, and the join is an equality on such keys.

Before anything is numbered, rows go whose value no row of the other side can match,
which its least and greatest value tell.

With two inequalities rows go on only if the second can still hold: a left row's
second number must be below the greatest of the right rows that the first allows, and
the other way round. That is tried on blocks of first numbers, ``BLOCKS`` at most,
before any row is copied to its keys, and then within each key. What goes on has a
partner, so it is at most twice the result, and is keyed by the second number in
the same way. Rows go there with all their columns, so a pair that is made is a row of
the result and moves nowhere: what is shuffled follows from the rows that have
partners, not from the pairs. A key with very many rows is split like any hot key, and the number of
tasks follows from the pairs, as few bytes can make very many.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hotkeys import hot_key_join
from .ordered import RANGE_ROWS, row_numbers
from .stages import staged

#: Blocks of first numbers, whose bounds are broadcast.
BLOCKS = 1 << 16

#: Rows of a side that a cell of pairs gets, about.
PAIR_ROWS = 1 << 12


@dataclass(frozen=True)
class Inequality:
    """left ``op`` right; ``op`` is <, <=, > or >=."""

    left: Column
    op: str
    right: Column

    def __post_init__(self) -> None:
        if self.op not in ("<", "<=", ">", ">="):
            raise ValueError(f"no inequality {self.op}")


def _numbers(left: DataFrame, right: DataFrame, by: Inequality, name: str, range_rows: int, on: Sequence[tuple[Column, Column]] = ()) -> DataFrame:
    """side, id, what must be equal, and the number of its value: the inequality holds if the left row's is the lower. Nulls have none."""
    # of equal values the right one comes first where they do not match, and last where they do
    side = lambda is_left: F.lit(int(is_left) if by.op in ("<", ">") else int(not is_left))
    keys = lambda i: F.struct(F.lit(0).alias("k"), *[pair[i].alias(f"k{n}") for n, pair in enumerate(on)]).alias("keys")

    def rows(df: DataFrame, i: int, value: Column) -> DataFrame:
        some = reduce(lambda a, b: a & b, [value.isNotNull(), *[pair[i].isNotNull() for pair in on]])
        return df.where(some).select(F.lit(not i).alias("is_left"), F.col("__id").alias("id"), keys(i), value.alias("v"), side(not i).alias("tie"))

    value = F.col("v").asc() if by.op in ("<", "<=") else F.col("v").desc()
    return row_numbers(rows(left, 0, by.left).unionByName(rows(right, 1, by.right)), [value, F.col("tie")], name, range_rows).select("is_left", "id", "keys", name)


def _keyed(rows: DataFrame, number: str, bits: int, level: str, node: str) -> DataFrame:
    """A row for each key that its number meets the other side's under: the bit's place and the bits above it."""
    places = F.expr(f"filter(sequence(0, {max(bits - 1, 0)}), s -> (shiftright({number}, s) & 1) = if(is_left, 0, 1))")
    return rows.withColumn(level, F.explode(places)).withColumn(node, F.expr(f"shiftright({number}, {level} + 1)"))


def _with_bounds(rows: DataFrame, bits: int) -> DataFrame:
    """The rows whose second number is within what the other side has beyond their block of first numbers: all that have a partner, and few others."""
    block = F.shiftright("p1", max(0, bits - BLOCKS.bit_length() + 1))
    ends = rows.groupBy(block.alias("of")).agg(F.min(F.when(F.col("is_left"), F.col("p2"))).alias("least"), F.max(F.when(~F.col("is_left"), F.col("p2"))).alias("most"))
    upto, onward = (Window.orderBy(x).rowsBetween(Window.unboundedPreceding, 0) for x in (F.col("of").asc(), F.col("of").desc()))
    bounds = staged(ends.select("of", F.min("least").over(upto).alias("least"), F.max("most").over(onward).alias("most")), "bounds").df  # a row a block
    return rows.join(F.broadcast(bounds), block == F.col("of")).where("if(is_left, p2 < most, p2 > least)").drop("of", "least", "most")


def _possible(left: DataFrame, right: DataFrame, by: Sequence[Inequality]) -> tuple[DataFrame, DataFrame]:
    """The rows whose values match the extreme one of the other side: no other row has a partner. A side without values leaves none."""
    less = [x.op in ("<", "<=") for x in by]
    least = [(F.min if up else F.max)(x.left).alias(f"__end{i}") for i, (x, up) in enumerate(zip(by, less, strict=True))]
    most = [(F.max if up else F.min)(x.right).alias(f"__end{i}") for i, (x, up) in enumerate(zip(by, less, strict=True))]
    lefts, rights = staged(left.agg(*least), "ends").df, staged(right.agg(*most), "ends").df  # a row each

    def holds(op: str, a: Column, b: Column) -> Column:
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    ends = [F.col(f"__end{i}") for i in range(len(by))]
    some = reduce(lambda a, b: a & b, [holds(x.op, x.left, end) for x, end in zip(by, ends, strict=True)])
    other = reduce(lambda a, b: a & b, [holds(x.op, end, x.right) for x, end in zip(by, ends, strict=True)])
    return left.join(F.broadcast(rights), some, "left_semi"), right.join(F.broadcast(lefts), other, "left_semi")


def partners(left: DataFrame, right: DataFrame, first: Inequality, second: Inequality | None, on: Sequence[tuple[Column, Column]], range_rows: int) -> tuple[DataFrame, str, int]:
    """is_left, id, keys, the number to go by, level and node, if two inequalities; its name; the bits of a number.

    With two inequalities these are rows that have a partner under their level and node; both sides have a unique long ``__id``.
    """
    left, right = _possible(left, right, [first] if second is None else [first, second])
    bits = max(1, (left.count() + right.count()).bit_length())
    one = staged(_numbers(left, right, first, "p1", range_rows, on), "numbers")
    if second is None:
        return one.df, "p1", bits
    two = _numbers(left, right, second, "p2", range_rows, on).drop("keys")
    both = staged(one.df.hint("merge").join(two.hint("merge"), ["is_left", "id"]), "numbers")
    one.drop()
    some = staged(_with_bounds(both.df, bits), "within")
    both.drop()
    keyed = _keyed(some.df, "p1", bits, "level", "node").select("is_left", "id", "keys", "p2", "level", "node")
    under = ["keys", "level", "node"]
    ends = keyed.groupBy(*under).agg(F.min(F.when(F.col("is_left"), F.col("p2"))).alias("least"), F.max(F.when(~F.col("is_left"), F.col("p2"))).alias("most")).where("least < most")
    alive = staged(keyed.hint("merge").join(ends.hint("merge"), under).where("if(is_left, p2 < most, p2 > least)").drop("least", "most"), "alive")
    some.drop()
    return alive.df, "p2", bits


def inequality_join(left: DataFrame, right: DataFrame, first: Inequality, second: Inequality | None = None, also: Column | None = None, how: str = "inner", range_rows: int = RANGE_ROWS, on: Sequence[tuple[Column, Column]] = (), cell_rows: int = PAIR_ROWS) -> DataFrame:
    """Rows of two sides of any size for which one or two inequalities hold, what ``on`` pairs is equal, and ``also``, a condition on the pair.

    ``how`` is inner, left, right, full, left_semi or left_anti. Column names must
    differ between the sides. Values may be of any type that has an order; a null
    matches nothing, in ``on`` too. Choose as inequalities the two that most pairs fail.
    """
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise ValueError(f"no inequality join of kind {how}")
    a, b = (staged(side.withColumn("__id", F.monotonically_increasing_id()), "side").df for side in (left, right))
    alive, number, bits = partners(a, b, first, second, on, range_rows)
    known = also is None and second is not None  # who has a partner
    if known and how in ("left_semi", "left_anti"):
        ids = alive.where("is_left").select(F.col("id").alias("__id"))
        return a.hint("merge").join(ids.hint("merge"), "__id", how).select(*left.columns)

    def keyed(side: DataFrame, is_left: bool, name: str) -> DataFrame:
        own = alive.where(F.col("is_left") == is_left)
        names = [c for c in side.columns if c != "__id"]
        side = side.select("__id", *[F.col(c).alias(f"__c{i}") for i, c in enumerate(names)])  # they may have any names
        rows = staged(own.hint("merge").join(side.hint("merge"), F.col("id") == F.col("__id")).drop("id"), "partners").df
        spread = _keyed(rows, number, bits, "__level", "__node")
        key = F.struct("keys", *([] if second is None else ["level", "node"]), "__level", "__node")
        return spread.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], F.col("__id").alias(f"__{name}_id"), key.alias(f"__{name}_at"))

    met = hot_key_join(keyed(a, True, "left"), keyed(b, False, "right"), "__left_at", "__right_at", "inner", cell_rows)
    met = met if also is None else met.where(also)
    if how == "inner":
        return met.select(*left.columns, *right.columns)
    if how in ("left_semi", "left_anti"):
        return a.hint("merge").join(met.select(F.col("__left_id").alias("__id")).hint("merge"), "__id", how).select(*left.columns)
    if known:
        partnered = lambda name: alive.where(F.col("is_left") == (name == "left")).select(F.col("id").alias("__id"))
    else:
        met = staged(met, "matches").df
        partnered = lambda name: met.select(F.col(f"__{name}_id").alias("__id"))
    found = [met.select(*left.columns, *right.columns)]
    nulls = lambda side: [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema]
    if how in ("left", "full"):
        found.append(a.hint("merge").join(partnered("left").hint("merge"), "__id", "left_anti").select(*left.columns, *nulls(right)))
    if how in ("right", "full"):
        found.append(b.hint("merge").join(partnered("right").hint("merge"), "__id", "left_anti").select(*nulls(left), *right.columns))
    return reduce(DataFrame.unionAll, found)


def join_of_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, also: Column | None, how: str) -> DataFrame:
    """The join of any kind that pairs of ``__id`` make of two tables, without these; of the pairs only those count for which ``also`` holds."""
    # by sort and merge: what Spark guesses of the sides from their compressed files may be far too little to broadcast them
    a, b = left, right
    left, right = a.drop("__id"), b.drop("__id")
    a, b = a.withColumnRenamed("__id", "__left"), b.withColumnRenamed("__id", "__right")
    ids = pairs.withColumnRenamed("left_id", "__left").withColumnRenamed("right_id", "__right")
    if also is None and how in ("left_semi", "left_anti"):
        return a.hint("merge").join(ids.select("__left").hint("merge"), "__left", how).select(*left.columns)
    met = ids.hint("merge").join(a.hint("merge"), "__left").hint("merge").join(b.hint("merge"), "__right")
    met = met if also is None else met.where(also)
    if how == "inner":
        return met.select(*left.columns, *right.columns)
    if how in ("left_semi", "left_anti"):
        return a.hint("merge").join(met.select("__left").hint("merge"), "__left", how).select(*left.columns)
    met = staged(met, "matches").df
    found = [met.select(*left.columns, *right.columns)]
    nulls = lambda side: [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema]
    if how in ("left", "full"):
        found.append(a.hint("merge").join(met.select("__left").hint("merge"), "__left", "left_anti").select(*left.columns, *nulls(right)))
    if how in ("right", "full"):
        found.append(b.hint("merge").join(met.select("__right").hint("merge"), "__right", "left_anti").select(*nulls(left), *right.columns))
    return reduce(DataFrame.unionAll, found)
