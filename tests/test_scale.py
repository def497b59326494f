import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loamwork.operators import Inequality, exact_nearest, exact_percentiles, inequality_join, nearest_join, not_in, ranks_in_order, row_numbers, running_totals_in_order
from loamwork.streaming import replay, silence_alerts, windowed_totals

R = random.Random(7)
LEFT = [(i, R.choice([None, *range(12)]), R.choice([None, *range(30)])) for i in range(90)]
RIGHT = [(i, R.choice([None, *range(12)]), R.choice([None, *range(30)])) for i in range(70)]
HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def side(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, {name}1 int, {name}2 int").repartition(3)


@pytest.mark.parametrize(("one", "two"), [("<", ">="), ("<=", "<"), (">", None)])
def test_inequalities_with_ties_and_nulls(spark, one, two):
    a, b = side(spark, LEFT, "a"), side(spark, RIGHT, "b")
    fit = lambda x, y, op: op is None or (x is not None and y is not None and HOLDS[op](x, y))
    pairs = {(x[0], y[0]) for x in LEFT for y in RIGHT if fit(x[1], y[1], one) and fit(x[2], y[2], two)}
    first, second = Inequality(F.col("a1"), one, F.col("b1")), two and Inequality(F.col("a2"), two, F.col("b2"))
    got = [tuple(r) for r in inequality_join(a, b, first, second, range_rows=40).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_kinds_of_inequality_join_and_a_condition_on_the_pair(spark):
    a, b = side(spark, LEFT, "a"), side(spark, RIGHT, "b")
    first, second, also = Inequality(F.col("a1"), "<", F.col("b1")), Inequality(F.col("a2"), ">", F.col("b2")), F.expr("(a + b) % 7 = 0")
    pairs = {(x[0], y[0]) for x in LEFT for y in RIGHT if None not in (x[1], x[2], y[1], y[2]) and x[1] < y[1] and x[2] > y[2] and (x[0] + y[0]) % 7 == 0}
    lefts, rights = {p[0] for p in pairs}, {p[1] for p in pairs}
    join = lambda how: inequality_join(a, b, first, second, also, how, range_rows=50)
    alone, lone = {(x[0], None) for x in LEFT if x[0] not in lefts}, {(None, y[0]) for y in RIGHT if y[0] not in rights}
    for how, want in (("left", pairs | alone), ("right", pairs | lone), ("full", pairs | alone | lone)):
        assert {tuple(r) for r in join(how).select("a", "b").collect()} == want
    assert {r["a"] for r in join("left_semi").collect()} == lefts
    assert {r["a"] for r in join("left_anti").collect()} == {x[0] for x in LEFT} - lefts
    with pytest.raises(ValueError):
        join("cross")
    assert inequality_join(a.limit(0), b, first, second).count() == 0


def test_no_pair_is_tried_that_does_not_match(spark):
    """Two sides of 3,000 rows, each pair of which meets one inequality and fails the other."""
    a = spark.range(3000).select(F.col("id").alias("a1"), F.col("id").alias("a2"))
    b = spark.range(3000).select((F.col("id") + 5000).alias("b1"), (F.col("id") + 5000).alias("b2"))
    found = inequality_join(a, b, Inequality(F.col("a1"), "<", F.col("b1")), Inequality(F.col("a2"), ">", F.col("b2")))
    assert found.count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_ranks_and_running_totals_over_many_ranges(spark):
    rows = [(i, R.choice([None, 1, 1, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v int").repartition(5)
    got = sorted((r["v"] is not None, r["v"] or 0, r["n"]) for r in row_numbers(df, [F.col("v").asc_nulls_first()], "n", range_rows=30).collect())
    assert [x[2] for x in got] == list(range(200))
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0)))
    ranked = {r["k"]: (r["rank"], r["dense"]) for r in ranks_in_order(df, [("v", "desc_nulls_last")], "rank", "dense", range_rows=2).collect()}
    distinct = []
    for _, v in order:
        if v not in distinct:
            distinct.append(v)
    assert ranked == {k: (1 + sum(1 for x in order if distinct.index(x[1]) < distinct.index(v)), 1 + distinct.index(v)) for k, v in rows}
    totals = running_totals_in_order(df, [F.col("k")], {"s": ("sum", "v"), "c": ("count", "v"), "m": ("max", "v"), "l": ("min", "v")}, range_rows=30)
    for r in totals.collect():
        upto = [v for k, v in rows if k <= r["k"] and v is not None]
        assert (r["s"], r["c"], r["m"], r["l"]) == ((sum(upto), len(upto), max(upto), min(upto)) if upto else (None, 0, None, None))
    assert running_totals_in_order(df.limit(0), [F.col("k")], {"s": ("sum", "v")}).count() == 0


def test_percentiles_of_a_group_that_spans_ranges(spark):
    rows = [("hot", float(R.choice([1, 1, 5, R.random()]))) for _ in range(300)] + [("one", 4.0), ("none", None), (None, 2.0), (None, 3.0)]
    got = {r["g"]: (r["a"], r["b"]) for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", {"a": 0.5, "b": 0.99}, range_rows=50).collect()}

    def at(g, share):
        v = sorted(x for k, x in rows if k == g and x is not None)
        p = (len(v) - 1) * share
        return v[int(p)] + (v[-(-p // 1).__int__() if p == int(p) else int(p) + 1] - v[int(p)]) * (p - int(p)) if p != int(p) else v[int(p)]

    assert set(got) == {"hot", "one", None}
    for g, (a, b) in got.items():
        assert a == pytest.approx(at(g, 0.5)) and b == pytest.approx(at(g, 0.99))


def test_not_in_and_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    kept = lambda values: sorted((r["x"] for r in not_in(df, "x", spark.createDataFrame(values, "y int"), "y").collect()), key=str)
    assert kept([(1,), (1,)]) == [2] and kept([(1,), (None,)]) == [] and kept([]) == [1, 2, None]


def test_an_index_finds_most_of_what_brute_force_finds(spark):
    centres = [[R.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + R.gauss(0, 0.4) for c in R.choice(centres)]) for i in range(1200)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 3), (5003, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    queries = df.where("id % 40 = 0 or id > 4999")
    true = {(r["query"], r["neighbour"]): r["score"] for r in exact_nearest(queries, df, "id", "v", 5, 16, block_rows=400).collect()}
    found = {(r["query"], r["neighbour"]): r["score"] for r in nearest_join(queries, df, "id", "v", 5, 16, tables=10, bits=6, probes=3).collect()}
    assert (5003, 0) in true and not any(q in (5000, 5001, 5002) for q, _ in true) and len(true) == 5 * 31
    both = set(true) & set(found)
    assert len(both) >= 0.9 * len(true) and all(found[x] == pytest.approx(true[x], abs=1e-5) for x in both)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def row(i, user, minutes):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes), user, "view", 1.0)


def test_a_replay_drops_late_rows_and_changes_no_setting(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    parts = [spark.createDataFrame(x, EVENTS) for x in ([row(1, 1, 5)], [row(2, 1, 600)], [row(3, 1, 6), row(4, 1, 605)], [row(5, 1, 1200)])]
    found = replay(parts, lambda s: windowed_totals(s.withWatermark("ts", "10 minutes"), "1 hour")).collect()
    assert {(r["window_start"].hour, r["n"]) for r in found} == {(0, 1), (10, 2)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_silence_is_told_once(spark):
    pytest.importorskip("google.protobuf")
    parts = [[row(1, 1, 0), row(1, 1, 0), row(2, 2, 1), row(3, 1, 200)], [row(4, 3, 1000)], [row(5, 1, 1001), row(5, 1, 1001)], [row(6, 3, 5000)]]
    found = replay([spark.createDataFrame(x, EVENTS) for x in parts], lambda s: silence_alerts(s.withWatermark("ts", "1 minute"), 3600)).collect()
    got = sorted((r["user_id"], int((r["silent_since"] - dt.datetime(2024, 1, 1)).total_seconds() // 60), r["of_day"]) for r in found)
    assert got == [(1, 0, 1), (1, 200, 2), (1, 1001, 3), (2, 1, 1), (3, 1000, 1)]
