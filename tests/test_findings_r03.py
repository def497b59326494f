"""What the review of round 3 found, each as a small case."""

import contextlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamwork.llm.near_text import fingerprints
from loamwork.llm.packing import pieces
from loamwork.llm.page_text import main_text
from loamwork.llm.quality_llr import with_trust
from loamwork.llm import lm_maxent, tokens
from loamwork.operators import Inequality, exact_nearest, hot_key_join, inequality_join, nearest_join, overlap_join
from loamwork.plans.relational import QUERIES
from loamwork.streaming import followed_by


def plan_of(df) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_sides_made_from_small_files_are_not_broadcast(spark):
    """the size of a side that is read from a file and then multiplied is guessed from the file."""
    a = spark.range(3000).select(F.col("id").alias("x"), (F.col("id") % 50).alias("g"), F.col("id").alias("b"), (F.col("id") + 40).alias("e"))
    b = a.select(*[F.col(c).alias(f"{c}2") for c in a.columns])
    joined = overlap_join(a, b, "b", "e", "b2", "e2", [("g", "g2")], F.col("x") < F.col("x2"), "full")
    assert "BroadcastHashJoin" not in plan_of(joined) and joined.count() == 3000 * 2
    assert "BroadcastHashJoin" not in plan_of(hot_key_join(a, b, "x", "x2", "full"))


def test_inequalities_with_equal_keys_make_no_pairs_that_move(spark):
    """a pair is a row of the result, and rows without a partner are not copied."""
    a = spark.range(300).select(F.col("id").alias("x"), (F.col("id") * 7 % 101).alias("p"), (F.col("id") % 3).alias("g"))
    b = a.select(*[F.col(c).alias(f"{c}2") for c in a.columns])
    lefts, rights = a.collect(), b.collect()
    want = sorted((r.x, s.x2) for r in lefts for s in rights if r.p > s.p2 and r.x <= s.x2 and r.g == s.g2)
    by = (Inequality(F.col("p"), ">", F.col("p2")), Inequality(F.col("x"), "<=", F.col("x2")))
    found = inequality_join(a, b, *by, on=[(F.col("g"), F.col("g2"))], cell_rows=16)
    assert sorted((r.x, r.x2) for r in found.select("x", "x2").collect()) == want
    full = inequality_join(a, b, *by, how="full", on=[(F.col("g"), F.col("g2"))]).select("x", "x2").collect()
    alone = [(x, None) for x in range(300) if x not in {w[0] for w in want}] + [(None, x) for x in range(300) if x not in {w[1] for w in want}]
    assert sorted(map(str, map(tuple, full))) == sorted(map(str, [*want, *alone]))


def test_first_order_of_each_customer_over_several_files(spark, tmp_path):
    """LATERAL ... ORDER BY ... LIMIT 1 gave any order once they lay in several partitions."""
    orders = spark.range(4000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), (F.col("id") * 7919 % 1009).cast("double").alias("o_totalprice"))
    orders.repartition(8, "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(60).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    best = {}
    for r in orders.collect():
        best[r.o_custkey] = max(best.get(r.o_custkey, (-1, 0)), (r.o_totalprice, -r.o_orderkey))
    found = QUERIES["lateral_join"](spark, str(tmp_path)).collect()
    assert sorted((r.c_custkey, r.o_orderkey) for r in found) == sorted((c, -k) for c, (_, k) in best.items())


def test_all_labelled_texts_are_trusted(spark):
    """no more than 20,000 were, and beyond the broadcast the same ones are."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    labels = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    for most in (1 << 19, 100):
        marked = with_trust(docs, labels, most_broadcast=most)
        assert marked.columns == ["doc_id", "text", "__trusted"] and marked.count() == 30_000
        assert marked.where("__trusted").agg(F.count("*"), F.max("doc_id")).first() == (25_000, 24_999)


def test_candidates_of_an_index_do_not_move(spark):
    """the pairs (query, neighbour) that met in the index went through a shuffle; now the best of each key do."""
    rows = [(i, [float((i // 10) % 7 == j) + 0.01 * ((i // 10) % 3) for j in range(8)]) for i in range(600)] + [(None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    found = nearest_join(df.where("id % 50 = 0"), df, "id", "v", 5, 8, tables=4, bits=4, probes=2, block_rows=16)
    plan = plan_of(found)
    assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(query" in plan
    assert not any("query" in line and "neighbour" in line for line in plan.splitlines() if "hashpartitioning" in line)
    want = exact_nearest(df.where("id % 50 = 0"), df, "id", "v", 5, 8, block_rows=100)
    got, true = (sorted((r.query, r.place, r.neighbour, r.score) for r in x.collect()) for x in (found, want))
    assert got == true and len(true) == 12 * 5  # equal vectors tie, and the smaller id comes first, in whatever cell they are met
    for query, place, neighbour, _ in true:
        same = [i for i in range(600) if (i // 10) % 21 == (query // 10) % 21 and i != query]
        assert neighbour == same[place - 1]


def test_workers_keep_no_tables_of_words_for_other_steps(spark):
    """pipeline: workers that had packed kept its tables of words through near-dedup."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text")).coalesce(1)

    def count(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([len(tokens._encoders)])], names=["doc_id"])

    kept = lambda: docs.select("doc_id").mapInArrow(count, "doc_id long").first()[0]
    packed = lambda: pieces(docs, "byte_bpe_50k.json", 2, 1024).collect()
    before = packed()
    assert kept() == 1  # one task follows another in one worker
    fingerprints(docs, 5).collect()
    assert kept() == 0 and packed() == before


def test_pages_that_declare_articles_are_differenced_too(spark):
    """F8: what markup declared was taken as it stood, so teasers that a site declares on each page were text."""
    teasers = "<div class='latest'><article><h2>Read our guide</h2><p>All about it</p></article><article><p>Win a trip</p></article></div>"
    page = lambda i, text: f"<nav>menu</nav><p>Acme</p><article><h1>Story {i}</h1><p>{text}</p></article>{teasers}<p>&copy; Acme</p>"
    rows = [(i, f"http://a.example/news/{i}", page(i, f"Only here {i}, and at greater length")) for i in range(5)]
    rows += [(10, "http://b.example/1", page(7, "A copied text, longer than the teasers")), (11, "http://b.example/2", page(7, "A copied text, longer than the teasers"))]
    rows += [(20, "http://c.example/1", page(8, "Alone on its host"))]
    got = {r.page_id: (r.text, r.n_shared) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(5):
        assert got[i] == (f"Story {i} Only here {i}, and at greater length", 3)
    assert got[10] == got[11] == ("Story 7 A copied text, longer than the teasers Read our guide All about it Win a trip", 0)
    assert got[20] == ("Story 8 Alone on its host Read our guide All about it Win a trip", 0)


def test_a_stream_joins_by_time_as_well_as_by_user(spark):
    """an event was tried with all of its user's in state."""
    rows = spark.range(400).selectExpr("id AS event_id", "id % 2 AS user_id", "timestamp_seconds(id * 7200) AS ts", "IF(id % 3 = 0, 'view', 'purchase') AS event_type")
    found = followed_by(rows, "view", "purchase", "6 HOURS")
    want = [(a % 2, a, b) for a in range(0, 400, 3) for b in range(a + 1, min(a + 4, 400)) if b % 3 and a % 2 == b % 2]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert any("Join [" in line and "first_span" in line for line in plan_of(found).splitlines())


def test_lm_sums_of_any_size_are_made_a_cache_at_a_time():
    """op1: what is added up fits a processor's cache however many tokens come, large groups are summed in pieces, and all is as by the plain way."""
    r = np.random.default_rng(5)
    model = lm_maxent.MaxentModel([], *[None] * 5, [r.normal(size=(k, 8)).astype(np.float32) for k in (1, 5, 3)], [r.normal(size=(64, 8)).astype(np.float32) for _ in range(3)])
    n = 2 * lm_maxent.AT_ONCE + 7
    given, rows = r.integers(0, 5, n), r.integers(0, 64, (4, n)).astype(np.uint16)
    want = np.exp(model.biases[1][given] + model.tables[1][rows].sum(axis=0))
    seen = np.zeros(n, dtype=int)
    for part, z, total in model.exponentials(1, given, rows):
        assert len(z) <= lm_maxent.AT_ONCE and np.allclose(z, want[part], rtol=1e-4) and np.allclose(total, want[part].sum(axis=1), rtol=1e-4)
        seen[part] += 1
    assert (seen == 1).all()
    for sizes in ([1], [16], [17], [5000, 300, 256, 257, 17, 16, 16, 2, 1, 1], [40, 1000, 33, 16, 15, 3], [1] * 9):
        counts = np.array(sizes)
        starts, order, values = np.cumsum(counts) - counts, r.permutation(counts.sum()), r.normal(size=(counts.sum(), 8))
        assert np.allclose(lm_maxent.grouped_sums(values, order, starts, counts), np.add.reduceat(values[order], starts))
