"""What the review of round 4 found, each as a small case."""

import operator

import pytest
from pyspark.sql import functions as F

from loamwork.operators import Inequality, hot_key_join, inequality_join


def test_pairs_of_a_hot_key_follow_tasks_by_their_number(spark):
    """where one side's rows of a hot key are broadcast, a task got a fixed number of the other's, however many pairs these make."""
    a = spark.range(20_000).select(F.col("id").alias("x"), F.lit(1).alias("k"))
    b = spark.range(4000).select(F.col("id").alias("x2"), F.lit(1).alias("k2"))
    found = hot_key_join(a, b, "k", "k2", cell_rows=1 << 12)
    made = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 80_000_000 and max(made) < 12_000_000


def test_pairs_of_few_bytes_go_to_many_tasks(spark):
    """tasks followed from the bytes read, so one task made nearly all pairs of a small table."""
    a = spark.range(12_000).select(F.col("id").alias("x"), (F.col("id") % 100).alias("p"))
    b = spark.range(12_000).select(F.col("id").alias("x2"), (F.col("id") % 100 + 1000).alias("p2"))
    found = inequality_join(a, b, Inequality(F.col("p"), "<", F.col("p2")), Inequality(F.col("x"), "<", F.col("x2")))
    made = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 12_000 * 11_999 // 2
    assert len(made) >= 4 and max(made) < sum(made) / 2


@pytest.mark.parametrize("ops", [("<", ">="), (">", "<="), (">=", ">"), ("<=", "<"), (">",), ("<=",)])
@pytest.mark.parametrize("how", ["inner", "full", "left_anti"])
def test_only_rows_that_can_match_are_numbered(spark, monkeypatch, ops, how):
    """all rows of both sides were sorted and numbered, though few can have a partner; NaN is the greatest value, null matches nothing."""
    from loamwork.operators import inequalities

    nan, numbered = float("nan"), []
    values = [None, nan, nan, *[float(i * 37 % 60) for i in range(60)]]
    rows = lambda shift: [(i, None if v is None else v + shift, None if i % 11 == 0 else float(i * 7 % 13)) for i, v in enumerate(values)]
    lefts, rights = rows(50.0 if ops[0] in ("<", "<=") else 0.0), rows(0.0 if ops[0] in ("<", "<=") else 50.0)
    a, b = spark.createDataFrame(lefts, "x long, p double, q double"), spark.createDataFrame(rights, "x2 long, p2 double, q2 double")
    kept = inequalities._numbers
    monkeypatch.setattr(inequalities, "_numbers", lambda left, right, *rest: numbered.append(left.count() + right.count()) or kept(left, right, *rest))
    by = [Inequality(F.col(c), op, F.col(f"{c}2")) for c, op in zip("pq", ops)]
    got = [tuple(r) for r in inequality_join(a, b, *by, how=how).select("x", *["x2"] * (how != "left_anti")).collect()]

    of = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    place = lambda v: (v != v, 0.0 if v != v else v)
    holds = lambda op, v, w: v is not None and w is not None and of[op](place(v), place(w))
    want = [(r[0], s[0]) for r in lefts for s in rights if all(holds(op, r[1 + i], s[1 + i]) for i, op in enumerate(ops))]
    left_alone, right_alone = ({r[0] for r in side} - {w[i] for w in want} for i, side in enumerate((lefts, rights)))
    if how == "full":
        want += [(x, None) for x in left_alone] + [(None, x) for x in right_alone]
    if how == "left_anti":
        want = [(x,) for x in left_alone]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert numbered and max(numbered) < 0.7 * (len(lefts) + len(rights))


def test_a_side_without_values_has_no_partners(spark):
    """the ends of such a side are null."""
    a = spark.range(5).select(F.col("id").alias("x"), F.col("id").alias("p"))
    b = spark.range(3).select(F.col("id").alias("x2"), F.lit(None).cast("long").alias("p2"))
    by = Inequality(F.col("p"), "<", F.col("p2")), Inequality(F.col("x"), ">=", F.col("x2"))
    for side in (b, b.limit(0)):
        assert inequality_join(a, side, *by).count() == 0
        assert inequality_join(a, side, *by, how="full").count() == 5 + side.count()
