"""More relational queries: other joins, aggregates, nested values and Python functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python import Tiles, luhn_digit, smoothed
from ..operators import global_rank, join_by, theta_join
from ..sources import read_table, register_views
from ..streaming import windowed_totals
from .relational import query, spark_sql


@query("""
    SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_acctbal > 4000 + 200.0 * n_nationkey AND s_name < n_name || 'z' OR n_name < s_name AND s_acctbal < 100.0 * n_nationkey
""")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = (F.col("s_acctbal") > 4000 + 200.0 * F.col("n_nationkey")) & (F.col("s_name") < F.concat("n_name", F.lit("z")))
    poor = (F.col("n_name") < F.col("s_name")) & (F.col("s_acctbal") < 100.0 * F.col("n_nationkey"))
    return theta_join(read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation"), rich | poor).select("s_suppkey", "n_name")


@query("SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta_join(read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "region"), None).select("s_suppkey", "r_name")


@query("""
    SELECT a.n_nationkey AS nation, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name
""")
def join_equi_and_less(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("r1"), F.col("n_name").alias("m1"))
    b = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("r2"), F.col("n_name").alias("m2"))
    return a.join(b, (F.col("r1") == F.col("r2")) & (F.col("m1") < F.col("m2"))).select("nation", "other")


def _hinted(strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        buyers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
        orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_totalprice")
        return join_by(orders, buyers, ["custkey"], strategy).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    run.__name__ = f"join_by_{strategy}"
    query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")(run)


for _strategy in ("broadcast", "hash", "merge"):
    _hinted(_strategy)


@query("""
    WITH sketches AS (
        SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, approx_count_distinct(l_partkey) AS near_parts, approx_quantile(l_extendedprice, 0.5) AS near_middle FROM lineitem GROUP BY l_returnflag
    )
    SELECT l_returnflag, any_value(parts) AS parts, count(*) AS n, any_value(abs(near_parts - parts) <= 0.1 * parts) AS distinct_near,
           abs(count(*) FILTER (WHERE l_extendedprice <= near_middle) - 0.5 * count(*)) <= 0.02 * count(*) AS middle_near
    FROM lineitem JOIN sketches USING (l_returnflag) GROUP BY l_returnflag
""")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sketches merged from parts are as near as they promise: distinct parts (HLL) within 10 %, the median's rank (KLL) within 2 %. Each engine asks its own sketches."""
    lines = read_table(spark, sf_dir, "lineitem")
    parts = lines.groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.hll_sketch_agg("l_partkey", F.lit(12)).alias("h"), F.kll_sketch_agg_double("l_extendedprice").alias("q"))
    merged = parts.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("h")).alias("near_parts"), F.kll_merge_agg_double("q").alias("q"))
    sketches = merged.select("l_returnflag", "near_parts", F.kll_sketch_get_quantile_double("q", F.lit(0.5)).alias("near_middle"))
    distinct = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
    below = lines.join(sketches.select("l_returnflag", "near_middle"), "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_extendedprice") <= F.col("near_middle")).alias("below"))
    near = lambda x, y, share, of: F.abs(x - y) <= share * of
    return below.join(distinct, "l_returnflag").join(sketches.select("l_returnflag", "near_parts"), "l_returnflag").select(
        "l_returnflag", "parts", "n", near(F.col("near_parts"), F.col("parts"), 0.1, F.col("parts")).alias("distinct_near"), near(F.col("below"), 0.5 * F.col("n"), 0.02, F.col("n")).alias("middle_near")
    )


@query("""
    SELECT n_regionkey, mode(n_nationkey % 2) AS most_often, round(var_pop(n_nationkey), 6) AS variance, round(stddev_pop(n_nationkey), 6) AS deviation,
           round(covar_pop(n_nationkey, n_regionkey), 6) AS together, min_by(n_name, n_nationkey) AS first_name, bool_or(n_nationkey = 7) AS has_seven,
           bit_xor(n_nationkey)::BIGINT AS bits
    FROM nation WHERE n_nationkey % 5 <> 4 GROUP BY n_regionkey
""")
def more_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return read_table(spark, sf_dir, "nation").where(key % 5 != 4).groupBy("n_regionkey").agg(
        F.mode(key % 2).alias("most_often"),
        F.round(F.var_pop(key), 6).alias("variance"),
        F.round(F.stddev_pop(key), 6).alias("deviation"),
        F.round(F.covar_pop(key, F.col("n_regionkey")), 6).alias("together"),
        F.min_by("n_name", key).alias("first_name"),
        F.bool_or(key == 7).alias("has_seven"),
        F.bit_xor(key).cast("long").alias("bits"),
    )


@query("""
    SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, min(n_nationkey) AS least, max_by(n_name, n_nationkey) AS last_nation,
           bool_and(n_nationkey >= 0) AS all_positive, count(*) AS n
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def lists_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("nation", "region"))
    return spark.sql("""
        SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations, min(n_nationkey) AS least, max_by(n_name, n_nationkey) AS last_nation,
               bool_and(n_nationkey >= 0) AS all_positive, count(*) AS n
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    """)


@query("""
    SELECT p_partkey, abs(p_size - 25)::BIGINT AS off, sqrt(p_retailprice) AS root, power(p_size, 2.0) AS squared, ln(p_retailprice) AS log,
           ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS down, sign(p_size - 25)::DOUBLE AS side, greatest(p_size, 10) AS most
    FROM part
""")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.abs(size - 25).cast("long").alias("off"),
        F.sqrt(price).alias("root"),
        F.pow(size, F.lit(2.0)).alias("squared"),
        F.ln(price).alias("log"),
        F.ceil(price).alias("up"),
        F.floor(price).alias("down"),
        F.signum(size - 25).alias("side"),
        F.greatest(size, F.lit(10)).alias("most"),
    )


@query(r"""
    SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL
""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,string>").alias("props"))
    return events.select("event_type", F.explode(F.map_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT label, round(avg(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 9) AS mean_square, max(len(embedding)) AS dimensions FROM embeddings GROUP BY label
""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    vectors = read_table(spark, sf_dir, "embeddings")
    return vectors.groupBy("label").agg(F.round(F.avg(squares), 9).alias("mean_square"), F.max(F.size("embedding")).cast("long").alias("dimensions"))


@query("""
    SELECT l_suppkey, measure, round(sum(amount), 2) AS amount FROM (
        SELECT l_suppkey, 'quantity' AS measure, l_quantity AS amount FROM lineitem UNION ALL SELECT l_suppkey, 'price', l_extendedprice FROM lineitem)
    GROUP BY ALL
""")
def unpivot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return lines.unpivot("l_suppkey", ["quantity", "price"], "measure", "amount").groupBy("l_suppkey", "measure").agg(F.round(F.sum("amount"), 2).alias("amount"))


@query("""
    SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS]) AS window_start FROM events)
    GROUP BY ALL
""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_totals(read_table(spark, sf_dir, "events"), "12 hours", "6 hours")


@query("""
    SELECT p_partkey, ((10 - list_sum(list_transform(range(len(p_partkey::VARCHAR)), lambda i:
        CASE WHEN i % 2 = 1 THEN reverse(p_partkey::VARCHAR)[i + 1]::BIGINT
             ELSE (2 * reverse(p_partkey::VARCHAR)[i + 1]::BIGINT) // 10 + (2 * reverse(p_partkey::VARCHAR)[i + 1]::BIGINT) % 10 END))::BIGINT % 10) % 10)::BIGINT AS digit
    FROM part
""")
def python_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", luhn_digit("p_partkey").alias("digit"))


@query("""
    WITH RECURSIVE ranked AS (SELECT n_regionkey, n_nationkey::DOUBLE AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
    steps AS (
        SELECT n_regionkey, i, x AS level FROM ranked WHERE i = 1
        UNION ALL SELECT r.n_regionkey, r.i, 0.3 * r.x + 0.7 * s.level FROM ranked r JOIN steps s ON r.n_regionkey = s.n_regionkey AND r.i = s.i + 1
    )
    SELECT n_regionkey, round(arg_max(level, i)::DOUBLE, 6) AS level FROM steps GROUP BY n_regionkey
""")
def python_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(read_table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_nationkey", 0.3).select("n_regionkey", F.round("level", 6).alias("level"))


@query("""
    SELECT tile, count(*) AS n FROM (SELECT unnest(range((s_suppkey % 7)::BIGINT, 20, 5)) AS tile FROM supplier) GROUP BY tile
""")
def python_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("supplier",))
    spark.udtf.register("tiles", Tiles)
    return spark.sql("SELECT t.tile, count(*) AS n FROM supplier, LATERAL tiles(s_suppkey % 7, 20, 5) t GROUP BY t.tile")


@query("""
    SELECT c_custkey, dearest, rank() OVER (ORDER BY dearest DESC NULLS LAST) AS place FROM customer
    LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS dearest FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey) ON c_custkey = o_custkey
""")
def nulls_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").where("o_totalprice > 450000").groupBy("o_custkey").agg(F.max("o_totalprice").alias("dearest"))
    buyers = read_table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "dearest")
    return global_rank(buyers, "dearest", "place")


@query(r"""
    WITH grams AS (
        SELECT doc_id, words[i] || ' ' || words[i + 1] AS gram FROM (
            SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents))
    )
    SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM grams GROUP BY gram ORDER BY n DESC, gram LIMIT 50
""")
def top_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report over whole texts: each place counts once, each document once more, and both are summed before the one shuffle."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    split = read_table(spark, sf_dir, "documents").select(words.alias("words")).where(F.size("words") > 1)
    n = F.size("words")
    grams = F.zip_with(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))
    counted = split.select(grams.alias("grams")).select(F.posexplode(F.array("grams", F.array_distinct("grams"))).alias("of_document", "grams")).select("of_document", F.explode("grams").alias("gram"))
    totals = counted.groupBy("gram").agg(F.count_if(F.col("of_document") == 0).alias("n"), F.sum("of_document").alias("docs"))
    return totals.orderBy(F.col("n").desc(), "gram").limit(50)


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, sha256(coalesce(text, '')) AS sha FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("digest"), F.sha2(text, 256).alias("sha"))
