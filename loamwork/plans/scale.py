"""Queries that no single task may hold: inequality joins, whole-table orders, percentiles of large groups, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import Inequality, exact_nearest, exact_percentiles, inequality_join, nearest_join, ranks_in_order, running_totals_in_order
from ..sources import read_table
from .relational import query


@query("""
    SELECT a.o_orderkey AS earlier, b.o_orderkey AS later FROM orders a JOIN orders b
    ON a.o_orderdate < b.o_orderdate AND a.o_totalprice >= b.o_totalprice + 490000
""")
def join_inequalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    a = orders.select(F.col("o_orderkey").alias("earlier"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"))
    b = orders.select(F.col("o_orderkey").alias("later"), F.col("o_orderdate").alias("at2"), (F.col("o_totalprice") + 490000).alias("price2"))
    return inequality_join(a, b, Inequality(F.col("price"), ">=", F.col("price2")), Inequality(F.col("at"), "<", F.col("at2"))).select("earlier", "later")


@query("""
    SELECT p_partkey, o_orderkey FROM part FULL JOIN (SELECT * FROM orders WHERE o_totalprice < 3000) ON p_retailprice > o_totalprice AND p_size >= month(o_orderdate) * 4 AND p_partkey % 10 = o_custkey % 10
""")
def join_inequalities_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").where("o_totalprice < 3000")
    joined = inequality_join(
        read_table(spark, sf_dir, "part"),
        orders,
        Inequality(F.col("p_retailprice"), ">", F.col("o_totalprice")),
        Inequality(F.col("p_size"), ">=", F.month("o_orderdate") * 4),
        how="full",
        on=[(F.col("p_partkey") % 10, F.col("o_custkey") % 10)],
    )
    return joined.select("p_partkey", "o_orderkey")


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER w AS rank_no, dense_rank() OVER w AS dense_no, round(percent_rank() OVER w, 9) AS share_below, round(cume_dist() OVER w, 9) AS share_upto
    FROM lineitem WINDOW w AS (ORDER BY l_quantity DESC NULLS LAST)
""")
def ranks_over_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty values over the whole table: each ties with a fiftieth of it."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ranked = ranks_in_order(lines, [("l_quantity", "desc_nulls_last")], "rank_no", "dense_no", "share_below", "share_upto")
    return ranked.withColumns({c: F.round(c, 9) for c in ("share_below", "share_upto")})


@query("""
    SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS so_far, count(*) OVER w AS orders_so_far, max(o_totalprice) OVER w AS dearest_so_far, min(o_totalprice) OVER w AS cheapest_so_far
    FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)
""")
def running_totals_over_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("exact"), "o_totalprice")
    totals = {"so_far": ("sum", "exact"), "orders_so_far": ("count", "o_orderkey"), "dearest_so_far": ("max", "o_totalprice"), "cheapest_so_far": ("min", "o_totalprice")}
    scanned = running_totals_in_order(orders, [F.col("o_orderdate"), F.col("o_orderkey")], totals)
    return scanned.select("o_orderkey", F.col("so_far").cast("double").alias("so_far"), "orders_so_far", "dearest_so_far", "cheapest_so_far")


@query("""
    SELECT 'all' AS part_of, quantile_cont(l_extendedprice, 0.01) AS low, quantile_cont(l_extendedprice, 0.5) AS middle, quantile_cont(l_extendedprice, 0.999) AS high FROM lineitem
""")
def percentiles_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group that is the whole table."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.lit("all").alias("part_of"), "l_extendedprice")
    return exact_percentiles(lines, ["part_of"], "l_extendedprice", {"low": 0.01, "middle": 0.5, "high": 0.999})


@query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 10 = 0 AND a.vec_id <> b.vec_id)
    SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS place, round(score, 6) AS score FROM s
    QUALIFY place <= 5
""")
def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every tenth vector, by brute force in blocks: what the index is measured by."""
    vectors = read_table(spark, sf_dir, "embeddings")
    found = exact_nearest(vectors.where("vec_id % 10 = 0"), vectors, "vec_id", "embedding", 5, 64)
    return found.select("query", "neighbour", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 10 = 0 AND a.vec_id <> b.vec_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS place FROM s QUALIFY place <= 5)
    SELECT count(*) AS wanted, true AS nine_tenths_found, round(sum(score), 3) AS score_wanted FROM t
""")
def nearest_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's recall against brute force: neighbours wanted, whether nine tenths of them are found, and the scores wanted."""
    vectors = read_table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 10 = 0")
    true = exact_nearest(queries, vectors, "vec_id", "embedding", 5, 64).select("query", "neighbour", "score")
    found = nearest_join(queries, vectors, "vec_id", "embedding", 5, 64, tables=12, bits=6, probes=4).select("query", "neighbour", F.lit(1).alias("hit"))
    met = true.join(found, ["query", "neighbour"], "left")
    return met.agg(F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("nine_tenths_found"), F.round(F.sum("score"), 3).alias("score_wanted"))
