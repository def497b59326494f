"""Findings of round 5: what the code before did not do."""

import datetime as dt
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamwork.operators import overlap_join
from loamwork.operators.overlaps import _binned, _levelled
from loamwork.plans import streams
from loamwork.streaming import replay, silence_alerts

R = random.Random(5)
KINDS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joined(lefts, rights, fit, how):
    """The rows of a join, by brute force; rows are tuples, some of them the same."""
    none_a, none_b = (None,) * len(lefts[0]), (None,) * len(rights[0])
    lone_a, lone_b = [a for a in lefts if not any(fit(a, b) for b in rights)], [b for b in rights if not any(fit(a, b) for a in lefts)]
    if how == "left_anti":
        return lone_a
    if how == "left_semi":
        return [a for a in lefts if any(fit(a, b) for b in rights)]
    out = [a + b for a in lefts for b in rights if fit(a, b)]
    out += [a + none_b for a in lone_a] if how in ("left", "full") else []
    return out + ([none_a + b for b in lone_b] if how in ("right", "full") else [])


def spans(n):
    """id, two keys, begin and end: a key with a third of the rows, others with few; nulls, empty and turned intervals, rows that come twice."""
    rows = [(i, R.choice(["hot", "hot", None, "a", "b", f"k{i % 9}"]), R.choice([1, 1, 1, None]), R.choice([None, *range(30)]), R.choice([0, 1, 3, 40, -2])) for i in range(n)]
    rows = [(i, k, m, None if b is None else float(b), None if b is None or i % 17 == 0 else float(b + size)) for i, k, m, b, size in rows]
    return rows + rows[:6]


@pytest.mark.parametrize("how", KINDS)
def test_overlaps_of_keys_with_few_and_with_many_rows(spark, how):
    """keys with few rows meet by the key, others by bins; the rows are the same wherever the line is drawn."""
    lefts, rights = spans(70), spans(60)
    a = spark.createDataFrame(lefts, "a long, k1 string, m1 int, b1 double, e1 double").repartition(3)
    b = spark.createDataFrame(rights, "b long, k2 string, m2 int, b2 double, e2 double").repartition(2)
    fit = lambda p, q: None not in p + q and p[1:3] == q[1:3] and p[3] < p[4] and q[3] < q[4] and p[3] < q[4] and q[3] < p[4] and (p[0] + q[0]) % 3 > 0
    want = sorted(joined(lefts, rights, fit, how), key=str)
    for key_rows in (0, 6, 1000) if how == "full" else (6,):
        found = overlap_join(a, b, "b1", "e1", "b2", "e2", [("k1", "k2"), ("m1", "m2")], F.expr("(a + b) % 3 > 0"), how, key_rows=key_rows)
        assert sorted(map(tuple, found.collect()), key=str) == want
        assert found.columns == (a.columns if how in ("left_semi", "left_anti") else a.columns + b.columns)


@pytest.mark.parametrize("how", KINDS)
def test_overlaps_by_key_of_sides_without_rows(spark, how):
    a = spark.createDataFrame([(1, 1, 2.0, 3.0), (2, None, 2.0, 3.0)], "a long, k1 int, b1 double, e1 double")
    b = a.toDF("b", "k2", "b2", "e2")
    join = lambda x, y: overlap_join(x, y, "b1", "e1", "b2", "e2", [("k1", "k2")], how=how).count()
    assert join(a, b.limit(0)) == (2 if how in ("left", "full", "left_anti") else 0)
    assert join(a.limit(0), b) == (2 if how in ("right", "full") else 0)
    assert join(a.limit(0), b.limit(0)) == 0


def test_overlaps_of_keys_with_few_rows_are_shuffled_once(spark):
    """each row was copied to some nine bins, pairs went back to both sides by two more joins, and each step was shuffled."""
    a = spark.range(400).selectExpr("id AS a", "id % 40 AS k1", "id * 1.0D AS b1", "id + 50.0D AS e1")
    b = a.toDF("b", "k2", "b2", "e2")
    plan = plan_of(overlap_join(a, b, "b1", "e1", "b2", "e2", [("k1", "k2")], how="full"))
    assert plan.count("Exchange") == 2 and "Generate" not in plan
    assert "Generate" in plan_of(overlap_join(a, b, "b1", "e1", "b2", "e2", [("k1", "k2")], key_rows=9))


def test_bins_of_both_sides_have_one_type(spark):
    """the key of one side was cast, so rows dealt by it were shuffled again."""
    rows = spark.range(9).select(F.col("id").alias("__id"), (F.col("id") * 10.0).alias("b1"), (F.col("id") * 10.0 + 1).alias("e1"))
    x = _levelled(rows, "b1", "e1")
    own, among = _binned(x, "l", F.array("level")), _binned(x, "r", F.filter(F.array(F.lit(0), F.lit(1)), lambda v: v >= F.col("level")))
    assert own.schema["l_key"].dataType == among.schema["r_key"].dataType


START = dt.datetime(2024, 1, 1)


def event(i, user, hours, kind="view"):
    return (i, None if hours is None else START + dt.timedelta(hours=hours), user, kind, 1.0, "{}")


def test_a_join_of_streams_keeps_its_state_in_one_store(spark, tmp_path, monkeypatch):
    """a task opened, loaded and committed four stores in each batch. Null users and times match nothing, events met twice match twice."""
    rows = [event(1, 1, 0), event(2, 1, 6, "purchase"), event(2, 1, 6, "purchase"), event(3, 1, 7, "purchase"), event(4, None, 1), event(5, None, 2, "purchase"), event(6, 2, None), event(7, 2, 3, "purchase")]
    rows += [event(8, 3, 191), event(9, 3, 193, "purchase"), event(10, 4, 400), event(11, 4, 401, "purchase"), event(12, 4, 401, "click"), event(13, 5, 500, "purchase"), event(14, 5, 500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(sys.modules[replay.__module__], "new_folder", lambda spark, tag: f"file://{tmp_path}/{tag}")
    assert sorted(map(tuple, streams.stream_join_of_two(spark, str(tmp_path)).collect())) == [(1, 1, 2), (1, 1, 2), (3, 8, 9), (4, 10, 11)]
    kept = {p.name for p in Path(tmp_path, "stream/state/state").rglob("*")}
    assert kept and not any("keyToNumValues" in x or "keyWithIndexToValue" in x for x in kept)


def test_silence_is_told_by_rows_also_of_events_without_an_id(spark):
    """each key's few rows of a batch became a data frame."""
    pytest.importorskip("google.protobuf")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    parts = [[event(None, 1, 0), event(None, 1, 3), event(1, 1, 5), event(1, 1, 5), event(2, None, 1), event(3, 2, None)], [event(None, 2, 6), event(4, 2, 6)], [event(1, 1, 5), event(5, 1, 6.5)], [event(6, 3, 90)]]
    parts = [spark.createDataFrame(x, schema) for x in parts]
    found = replay(parts, lambda s: silence_alerts(s.withWatermark("ts", "3 hours"), 3600))
    assert dict(found.dtypes) == {"user_id": "bigint", "silent_since": "timestamp", "of_day": "int", "__batch": "int"}
    got = sorted((r["user_id"], (r["silent_since"] - START).total_seconds() / 3600, r["of_day"]) for r in found.collect())
    assert got == [(1, 0, 1), (1, 3, 2), (1, 5, 3), (1, 6.5, 4), (2, 6, 1)]
    assert "InPandas" not in plan_of(silence_alerts(parts[0].withWatermark("ts", "1 minute"), 3600))
