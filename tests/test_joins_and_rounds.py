import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamwork.functions.partials import MinHash, PartialAggregate, aggregate_in_python
from loamwork.operators import fixpoint, hot_key_join, overlap_join, reachable, theta_join
from loamwork.operators.hotkeys import frequent_keys

R = random.Random(11)
KINDS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


def joined(lefts, rights, fit, how):
    """The rows of a join, by brute force; rows are tuples."""
    pairs = [(a, b) for a in lefts for b in rights if fit(a, b)]
    met_a, met_b = {a for a, _ in pairs}, {b for _, b in pairs}
    none_a, none_b = (None,) * len(lefts[0]), (None,) * len(rights[0])
    if how == "left_semi":
        return [a for a in lefts if a in met_a]
    if how == "left_anti":
        return [a for a in lefts if a not in met_a]
    out = [a + b for a, b in pairs]
    out += [a + none_b for a in lefts if a not in met_a] if how in ("left", "full") else []
    return out + ([none_a + b for b in rights if b not in met_b] if how in ("right", "full") else [])


def same(found, want):
    return sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("how", KINDS)
def test_hot_keys_on_one_side_on_both_and_without_a_partner(spark, how):
    keys = [1] * 60 + [2] * 45 + [3] * 40 + [None] * 30 + [*range(10, 30)]
    others = [1] * 25 + [4] * 50 + [2] + [None] * 20 + [*range(20, 40)] * 2
    lefts, rights = [(i, k) for i, k in enumerate(keys)], [(i, k) for i, k in enumerate(others)]
    a, b = spark.createDataFrame(lefts, "a long, x int").repartition(3), spark.createDataFrame(rights, "b long, y long").repartition(3)
    found = hot_key_join(a, b, "x", "y", how, cell_rows=12)
    assert same(found, joined(lefts, rights, lambda p, q: p[1] is not None and p[1] == q[1], how))
    assert found.columns == (["a", "x"] if how in ("left_semi", "left_anti") else ["a", "x", "b", "y"])


def test_frequent_keys_are_all_found_with_their_counts(spark):
    a = spark.range(1000).select(F.when(F.col("id") < 300, F.lit(7)).otherwise(F.col("id")).alias("x"))
    b = spark.range(400).select(F.when(F.col("id") < 150, F.lit(9)).otherwise(F.col("id") % 100).alias("y"))
    assert {tuple(r) for r in frequent_keys(a, b, "x", "y", cell_rows=100).collect()} == {(7, 300, 2), (9, 0, 152)}


def test_no_cell_of_a_hot_key_holds_much_of_it(spark):
    """A key with a third of the rows: the rows of its largest cell are counted in the join's own input."""
    from loamwork.operators.hotkeys import _dealt

    a = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("x"), F.col("id").alias("a"))
    b = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("y"))
    hot = frequent_keys(a, b, "x", "y", cell_rows=100)
    cells = _dealt(a, "x", hot, "__i", "__j", 100).groupBy("x", "__i", "__j").count()
    assert cells.agg(F.max("count")).first()[0] < 200 and cells.count() == 30 * 3
    assert hot_key_join(a, b, "x", "y", cell_rows=100).count() == 3000 * 300 + 600


def test_rows_that_repeat_empty_sides_and_kinds(spark):
    a, b = spark.createDataFrame([(1,)] * 30 + [(None,)] * 2, "x int"), spark.createDataFrame([(1,)] * 20, "y int")
    assert hot_key_join(a, b, "x", "y", "full", cell_rows=5).count() == 602
    assert hot_key_join(a, b.limit(0), "x", "y", "left", cell_rows=5).count() == 32
    assert hot_key_join(a.limit(0), b, "x", "y", "right", cell_rows=5).count() == 20
    assert hot_key_join(a, b, "x", "y", "left_semi", cell_rows=1000).count() == 30
    with pytest.raises(ValueError):
        hot_key_join(a, b, "x", "y", "cross")


def intervals(n, longest):
    rows = [(i, R.choice([None, R.randint(-50, 50), R.randint(0, 5)]), R.choice([0, 1, 1, 3, longest, longest * R.random()])) for i in range(n)]
    return [(i, None if b is None else float(b), None if b is None or i % 17 == 0 else float(b + size)) for i, b, size in rows]


@pytest.mark.parametrize("how", KINDS)
def test_overlaps_of_all_lengths(spark, how):
    lefts, rights = intervals(60, 90), intervals(50, 700)
    a, b = spark.createDataFrame(lefts, "a long, b1 double, e1 double").repartition(3), spark.createDataFrame(rights, "b long, b2 double, e2 double").repartition(2)
    full = lambda r: None not in r and r[1] < r[2]
    fit = lambda p, q: full(p) and full(q) and p[1] < q[2] and q[1] < p[2]
    assert same(overlap_join(a, b, "b1", "e1", "b2", "e2", how=how, cell_rows=40), joined(lefts, rights, fit, how))
    also = F.expr("(a + b) % 3 = 0")
    assert same(overlap_join(a, b, "b1", "e1", "b2", "e2", also=also, how=how), joined(lefts, rights, lambda p, q: fit(p, q) and (p[0] + q[0]) % 3 == 0, how))


@pytest.mark.parametrize("how", ["full", "left_anti"])
def test_overlaps_by_key(spark, how):
    lefts, rights = ([(i, R.choice([None, "x", "x", "y", "z"]), b, e) for i, b, e in intervals(50, 60)] for _ in range(2))
    a, b = spark.createDataFrame(lefts, "a long, k1 string, b1 double, e1 double"), spark.createDataFrame(rights, "b long, k2 string, b2 double, e2 double")
    fit = lambda p, q: None not in p and None not in q and p[1] == q[1] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]
    assert same(overlap_join(a, b, "b1", "e1", "b2", "e2", [("k1", "k2")], how=how, cell_rows=20), joined(lefts, rights, fit, how))


def test_overlaps_of_times_and_of_nothing(spark):
    a = spark.sql("SELECT 1 AS a, timestamp'2024-01-01 10:00:00' AS b1, timestamp'2024-01-01 11:00:00' AS e1")
    b = spark.sql("SELECT id AS b, timestamp'2024-01-01 11:00:00' + make_interval(0, 0, 0, 0, 0, 0, (id - 2) * 0.000001) AS b2, timestamp'2025-01-01' AS e2 FROM range(4)")
    assert {r["b"] for r in overlap_join(a, b, "b1", "e1", "b2", "e2").collect()} == {0, 1}
    assert overlap_join(a.limit(0), b, "b1", "e1", "b2", "e2").count() == 0
    assert overlap_join(a, b.limit(0), "b1", "e1", "b2", "e2", how="left").count() == 1


def test_short_intervals_in_one_long_ones_bin_are_not_tried_with_each_other(spark):
    """2,000 short intervals a side, none of which meet, under one that spans them all: pairs out of the joins follow the rows."""
    from loamwork.operators.overlaps import _binned, _levelled

    a = spark.range(2000).select(F.col("id").alias("__id"), (F.col("id") * 10.0).alias("b1"), (F.col("id") * 10.0 + 1).alias("e1"))
    b = spark.range(2000).select(F.col("id").alias("__id"), (F.col("id") * 10.0 + 5).alias("b2"), (F.col("id") * 10.0 + 6).alias("e2"))
    b = b.union(spark.sql("SELECT 9999L, -5.0D, 30000.0D"))
    x, y = _levelled(a, "b1", "e1"), _levelled(b, "b2", "e2")
    levels = sorted({r[0] for r in x.union(y).select("level").distinct().collect()})
    fine = lambda rows, p, test: _binned(rows, p, F.filter(F.array(*map(F.lit, levels)), test))
    one = _binned(x, "l", F.array("level")).join(fine(y, "r", lambda v: v >= F.col("level")), F.col("l_key") == F.col("r_key"))
    two = fine(x, "l", lambda v: v > F.col("level")).join(_binned(y, "r", F.array("level")), F.col("l_key") == F.col("r_key"))
    assert one.count() + two.count() < 5 * 4001


@pytest.mark.parametrize("how", KINDS)
def test_theta_joins_of_sides_too_large_to_broadcast(spark, how):
    lefts, rights = ([(i, R.choice([None, *range(20)])) for i in range(n)] for n in (70, 50))
    a, b = spark.createDataFrame(lefts, "a long, x int").repartition(3), spark.createDataFrame(rights, "b long, y int").repartition(2)
    fit = lambda p, q: None not in (p[1], q[1]) and (p[1] * q[1]) % 13 == 5
    assert same(theta_join(a, b, F.expr("(x * y) % 13 = 5"), how, most_rows=10, cell_rows=16), joined(lefts, rights, fit, how))
    assert theta_join(a, b.limit(0), F.expr("x < y"), how, most_rows=-1, cell_rows=16).count() == (70 if how in ("left", "full", "left_anti") else 0)


def test_reach_with_loops_repeats_and_nulls(spark):
    edges = [(i, i + 1) for i in range(25)] + [(25, 3), (5, 5), (0, 1), (0, 1), (None, 4), (4, None), (100, 101), (7, 20)]
    df = spark.createDataFrame(edges, "s int, t int")
    found = {r["node"]: r["steps"] for r in reachable(df, spark.createDataFrame([(0,), (0,), (None,)], "n int"), "s", "t").collect()}
    want, front, steps = {0: 0}, {0}, 0
    while front:
        steps += 1
        front = {t for s, t in edges if s in front and t is not None and t not in want}
        want |= dict.fromkeys(front, steps)
    assert found == want
    assert {r["node"] for r in reachable(df, spark.createDataFrame([(0,)], "n int"), "s", "t", most_rounds=2).collect()} == {0, 1, 2}
    assert reachable(df, spark.createDataFrame([], "n int"), "s", "t").count() == 0


def test_a_fixpoint_of_pairs(spark):
    """All pairs of a chain with a loop, each found in one round only."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "f int, t int")
    step = lambda new: new.alias("n").join(edges.alias("e"), F.expr("n.t = e.f")).select("n.f", "e.t")
    rows = [tuple(r) for r in fixpoint(edges, step, ["f", "t"]).select("f", "t").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}


class Span(PartialAggregate):
    state = "low double, high double, rows bigint"
    result = "span double, rows bigint"

    def partial(self, rows: pd.DataFrame) -> tuple:
        return float(rows["v"].min()), float(rows["v"].max()), len(rows)

    def merge(self, states: pd.DataFrame) -> tuple:
        return float(states["low"].min()), float(states["high"].max()), int(states["rows"].sum())

    def finish(self, state: tuple) -> tuple:
        return state[1] - state[0], state[2]


@pytest.mark.parametrize("most_states", [3, 50_000])
def test_python_aggregates_merge_their_states(spark, most_states):
    rows = [(R.choice(["hot", "hot", "hot", None, *"abcdefghij"]), R.choice([1, 2]), R.random()) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, m int, v double").repartition(7)
    got = {(r["k"], r["m"]): (r["span"], r["rows"]) for r in aggregate_in_python(df, ["k", "m"], ["v"], Span(), most_states).collect()}
    groups = {}
    for k, m, v in rows:
        groups.setdefault((k, m), []).append(v)
    assert got == {k: (pytest.approx(max(v) - min(v)), len(v)) for k, v in groups.items()}
    assert aggregate_in_python(df.limit(0), ["k"], ["v"], Span()).count() == 0


def test_signatures_with_nulls(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("b", None), ("a", 70000)], "k string, x long").repartition(3)
    got = {r["k"]: r["signature"] for r in aggregate_in_python(df, ["k"], ["x"], MinHash("x", 4)).collect()}
    assert got["b"] is None
    assert got["a"] == [min(((2 * i + 1) * 40503 * x + 7919 * i) % 65521 for x in (5, 70000)) for i in range(4)]
