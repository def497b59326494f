import datetime as dt

import random

import pytest
from pyspark.sql import functions as F

from loamwork.operators import asof_join, exact_percentile, global_rank, range_join, sessionize, theta_join
from loamwork.sources import read_table
from loamwork.streaming import events_stream, windowed_totals


def test_asof_join_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (None, 5, "c"), (2, 5, "d"), (1, None, "e")], "k int, at int, id string")
    right = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (1, 3, "z"), (None, 1, "n")], "k int, t int, v string")
    got = {r["id"]: (r["t"], r["v"]) for r in asof_join(left, right, ["k"], "at", "t", ["v"]).collect()}
    assert got == {"a": (5, "x"), "b": (None, None), "c": (None, None), "d": (None, None), "e": (None, None)}
    assert {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "at", "t", ["v"], strict=True).collect()}["a"] == "z"


def test_range_join_against_brute_force(spark):
    points, spans = [-3.5, 0.0, 2.0, 9.99, 10.0, None], [(0, 10.0), (-4.0, 2.0), (5, 5), (9.0, 30.0), (None, 3.0)]
    p = spark.createDataFrame([(x,) for x in points], "at double")
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(None if a is None else float(a), float(b)) for a, b in spans])], "id int, lo double, hi double")
    got = sorted((r["at"], r["id"]) for r in range_join(p, s, "at", "lo", "hi", width=4).collect())
    assert got == sorted((x, i) for x in points if x is not None for i, (a, b) in enumerate(spans) if a is not None and a <= x < b)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_range_join_kinds_and_long_intervals(spark, how):
    points = [-50.0, 0.5, 7.0, 7.0, 300.0, 5e5, 9e9, None]
    spans = [(0.0, 1.0), (0.0, 10.0), (-1e6, 1e6), (299.0, 301.0), (5.0, 5.0), (9.0, 2.0), (250.0, 1000.0)]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "p int, at double")
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "id int, lo double, hi double")
    met = [(i, k) for i, x in enumerate(points) if x is not None for k, (a, b) in enumerate(spans) if a <= x < b]
    alone = [i for i in range(len(points)) if i not in {i for i, _ in met}]
    want = {"inner": met, "left": met + [(i, None) for i in alone], "left_semi": sorted({i for i, _ in met}), "left_anti": alone}[how]
    rows = range_join(p, s, "at", "lo", "hi", width=1, how=how).collect()
    got = [r["p"] for r in rows] if "semi" in how or "anti" in how else [(r["p"], r["id"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert range_join(p, s.limit(0), "at", "lo", "hi", width=1, how=how).count() == {"inner": 0, "left": 8, "left_semi": 0, "left_anti": 8}[how]
    with pytest.raises(ValueError):
        range_join(p, s, "at", "lo", "hi", width=1, how="right")


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_in_buckets_of_time(spark, strict):
    r = random.Random(3)
    left = spark.createDataFrame([(r.choice([1, 2, None]), r.choice([None, *range(60)]), i) for i in range(200)], "k int, at int, id int")
    right = spark.createDataFrame([(r.choice([1, 1, 2, None]), r.choice([None, *range(60)]), str(i)) for i in range(60)], "k int, t int, v string")
    whole = sorted(map(str, asof_join(left, right, ["k"], "at", "t", ["v"], strict).collect()))
    for every in (1, 7, 1000):
        assert sorted(map(str, asof_join(left, right, ["k"], "at", "t", ["v"], strict, every=every).collect())) == whole


def test_sessions_in_buckets_of_time(spark):
    r, at = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(r.choice([1, 2, None]), None if i % 50 == 0 else at + dt.timedelta(seconds=r.randrange(5000)), i) for i in range(300)]
    events = spark.createDataFrame(rows, "u int, ts timestamp, i int")
    whole = sorted(map(str, sessionize(events, ["u"], "ts", 30, tie=["i"]).collect()))
    for every in (10, 100, 100_000):
        assert sorted(map(str, sessionize(events, ["u"], "ts", 30, tie=["i"], every=every).collect())) == whole


def test_percentiles_ranks_and_joins_on_any_condition(spark):
    table = spark.createDataFrame([(i % 3, None if i == 4 else float(i * i % 17)) for i in range(40)] + [(9, None)], "g int, x double")
    want = {r["g"]: r["p"] for r in table.groupBy("g").agg(F.percentile("x", 0.3).alias("p")).collect()}
    got = {r["g"]: r["p"] for r in exact_percentile(table, ["g"], "x", 0.3, "p").collect()}
    assert got == pytest.approx({g: p for g, p in want.items() if p is not None})
    values = sorted((r["x"] for r in table.collect()), key=lambda x: (x is None, -(x or 0)))
    assert {(r["x"], r["n"]) for r in global_rank(table, "x", "n", buckets=5).collect()} == {(x, values.index(x) + 1) for x in values}
    assert global_rank(table.limit(0), "x", "n").count() == 0
    small = spark.range(3)
    assert theta_join(table, small, F.col("x") < F.col("id")).count() == sum(x is not None and x < i for x in values for i in range(3))
    assert theta_join(table, small, None).count() == 3 * len(values)
    assert theta_join(table, small, None, most_rows=2, cell_rows=2).count() == 3 * len(values)
    with pytest.raises(ValueError):
        theta_join(table, small, None, how="cross")


def test_sessions_keep_an_event_one_gap_later(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at), (1, at + dt.timedelta(seconds=30)), (1, at + dt.timedelta(seconds=61)), (2, at)]
    got = sessionize(spark.createDataFrame(rows, "u int, ts timestamp"), ["u"], "ts", 30).orderBy("u", "ts").collect()
    assert [r["session_no"] for r in got] == [1, 1, 2, 1]


def test_stream_gives_the_closed_windows_of_the_table(spark, sf_dir, tmp_path):
    events = read_table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_totals(events_stream(spark, str(tmp_path / "in"), events.schema), "6 hours")
    running = stream.writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    running.awaitTermination(120)
    got, want = {tuple(r) for r in spark.table("totals").collect()}, {tuple(r) for r in windowed_totals(events, "6 hours").collect()}
    assert got <= want and {r[0] for r in want - got} <= {max(r[0] for r in want)}


def test_running_totals_and_first_rows_of_a_stream(spark, sf_dir, tmp_path):
    from loamwork.streaming import first_of_each, running_totals

    events = read_table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = events_stream(spark, str(tmp_path / "in"), events.schema, late="60 days")
    for name, stream, mode in (("running", running_totals(source), "update"), ("firsts", first_of_each(source, "user_id").select("user_id"), "append")):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
    want = {r["user_id"]: (r["n"], round(r["total"], 6)) for r in events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
    got = {}
    for r in spark.table("running").collect():
        got[r["user_id"]] = max(got.get(r["user_id"], (0, 0.0)), (r["n"], round(r["total"], 6)))
    assert got == want
    assert sorted(r["user_id"] for r in spark.table("firsts").collect()) == sorted(want)


def streamed(stream, name, mode, folder):
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder / f"of-{name}")).start()
    running.awaitTermination(180)
    return stream.sparkSession.table(name).collect()


def in_files(spark, folder, batches, schema):
    """One file for each list of rows, to be read one at a time in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "in" / f"batch={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_a_late_row_is_dropped(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    row = lambda i, minutes: (i, at + dt.timedelta(minutes=minutes), 1, "view", 1.0)
    source = in_files(spark, tmp_path, [[row(1, 5)], [row(2, 600)], [row(3, 605)], [row(4, 6)], [row(5, 1200)], [row(6, 1800)]], EVENTS).withWatermark("ts", "10 minutes")
    got = {r["window_start"].hour: r["n"] for r in streamed(windowed_totals(source, "1 hour"), "late", "append", tmp_path)}
    assert got == {0: 1, 10: 2, 20: 1}  # the fourth row came when its window was closed


def test_sessions_of_a_stream(spark, tmp_path):
    from loamwork.streaming import session_totals

    at = dt.datetime(2024, 1, 1)
    row = lambda i, user, minutes: (i, at + dt.timedelta(minutes=minutes), user, "view", 2.0)
    source = in_files(spark, tmp_path, [[row(1, 1, 0), row(2, 2, 3)], [row(3, 1, 20), row(4, 2, 50)], [row(5, 3, 5000)], [row(6, 3, 9000)]], EVENTS).withWatermark("ts", "30 minutes")
    got = {(r["user_id"], r["session_start"].minute, r["n"], r["total"]) for r in streamed(session_totals(source, "30 minutes"), "stays", "append", tmp_path) if r["user_id"] < 3}
    assert got == {(1, 0, 2, 4.0), (2, 3, 1, 2.0), (2, 50, 1, 2.0)}


def test_levels_kept_in_state(spark, tmp_path):
    from loamwork.streaming import smoothed_levels

    at = dt.datetime(2024, 1, 1)
    row = lambda i, user, value: (i, at + dt.timedelta(minutes=i), user, "view", value)
    source = in_files(spark, tmp_path, [[row(1, 1, 10.0), row(2, 1, 20.0), row(3, 2, 5.0)], [row(4, 1, None), row(5, 1, 0.0)]], EVENTS)
    got = [(r["user_id"], round(r["level"], 6)) for r in streamed(smoothed_levels(source), "levels", "update", tmp_path)]
    assert sorted(got) == [(1, 9.1), (1, 13.0), (2, 5.0)]


def test_longest_gaps_kept_in_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from loamwork.streaming import longest_gaps

    at = dt.datetime(2024, 1, 1)
    row = lambda i, user, seconds: (i, at + dt.timedelta(seconds=seconds), user, "view", 1.0)
    source = in_files(spark, tmp_path, [[row(1, 1, 0), row(2, 1, 5), row(3, 2, 1)], [row(4, 1, 9)], [row(5, 1, 100), row(6, 2, 3)]], EVENTS)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = [(r["user_id"], r["seconds"]) for r in streamed(longest_gaps(source), "gaps", "update", tmp_path)]
    finally:
        spark.conf.unset(key)
    assert sorted(got) == [(1, 5.0), (1, 91.0), (2, 2.0)]


def test_events_at_a_steady_rate(spark, tmp_path):
    from loamwork.streaming import rate_stream

    running = rate_stream(spark, 50).writeStream.format("memory").queryName("steady").option("checkpointLocation", str(tmp_path / "steady")).start()
    try:
        for _ in range(60):
            if spark.table("steady").count():
                break
            running.awaitTermination(1)
    finally:
        running.stop()
    assert {r["event_type"] for r in spark.table("steady").collect()} <= {"click", "view", "purchase"}
