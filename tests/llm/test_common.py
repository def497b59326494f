import pytest
from pyspark.sql import functions as F

from loamwork.llm import common
from loamwork.llm.exact_dedup import exact_dedup, mark_duplicates

from .test_exact_and_mix import brute_classes

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def moved_rows(df):
    """Rows that each shuffle of ``df`` moved, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if name == "ShuffleExchangeExec":
            found.append(p.metrics().apply("shuffleRecordsWritten").value())
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_rows_that_are_not_wanted_do_not_move(spark, monkeypatch, how):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    docs = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = spark.range(0, 40_000, 400).select(F.col("id").alias("doc_id"))
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = common.joined_by_id(docs, ids, "doc_id", how)
        assert max(moved_rows(got)) < 3_000
        assert {r["doc_id"] for r in got.collect()} == {k for k in range(40_000) if (k % 400 == 0) == (how == "left_semi")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)


def test_the_filter_lets_all_wanted_through_and_few_others(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"))
    ids = docs.where("doc_id % 50 = 0")
    marked = common.with_filter(docs, ids, "doc_id", 2_000).groupBy((F.col("doc_id") % 50 == 0).alias("wanted")).agg(F.avg(F.col("__maybe").cast("int")).alias("x"))
    shares = {r["wanted"]: r["x"] for r in marked.collect()}
    assert shares[True] == 1 and 0 < shares[False] < 0.05


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
@pytest.mark.parametrize("most", [0, 1 << 19])
def test_ids_that_are_null_repeated_or_strings(spark, monkeypatch, how, most):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    docs = spark.createDataFrame([(None, "a"), ("x", "b"), ("x", "c"), ("y", "d")], "doc_id string, text string")
    ids = spark.createDataFrame([(None,), ("x",), ("z",)], "doc_id string")
    got = sorted(r["text"] for r in common.joined_by_id(docs, ids, "doc_id", how).collect())
    assert got == (["a", "b", "c"] if how == "left_semi" else ["d"])
    none = common.joined_by_id(docs, ids.limit(0), "doc_id", how)
    assert none.count() == (0 if how == "left_semi" else 4) and none.columns == docs.columns


def test_exact_dedup_beyond_what_is_broadcast(make, odd_rows, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    docs = make(odd_rows)
    assert sorted(map(tuple, mark_duplicates(docs).collect()), key=str) == brute_classes(odd_rows)
    kept = {r[0] for r in brute_classes(odd_rows) if r[3]}
    assert {r["doc_id"] for r in exact_dedup(docs).collect()} == kept


def test_settings_of_the_session_stay(spark):
    own = spark.newSession()
    own.conf.set(BATCH, "10000")
    common.small_batches(own)
    assert own.conf.get(BATCH) == "10000"
    with common._cleanup.of(own):
        with common._cleanup.of(own):
            pass
        assert own.conf.get(common._CLEANUP) == "true"
    assert common._CLEANUP not in own.conf.getAll
    own.conf.set(common._CLEANUP, "false")
    with common._cleanup.of(own):
        pass
    assert own.conf.get(common._CLEANUP) == "false"
