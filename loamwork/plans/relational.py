"""Relational queries over the star schema, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import concat_skipping_nulls, cosine, day_of_week, divide_or_null, sample_skewness, substring_from
from ..operators import asof_join, exact_percentile, not_in, range_join, sessionize, top_k_per_group
from ..sources import read_table, register_views
from ..streaming import session_totals, windowed_totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register the function under its name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def spark_sql(name: str, tables: tuple[str, ...], sql: str, oracle: str | None = None) -> None:
    """Register a query that is Spark SQL itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, tables)
        return spark.sql(sql)

    run.__name__ = name
    query(oracle or sql)(run)


def total(x: str | Column) -> Column:
    return F.round(F.sum(x), 2)


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
    FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        total("l_quantity").alias("sum_qty"),
        total(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.count(F.lit(1)).alias("n_lines"),
    )


@query("""
    SELECT o_orderkey, o_totalprice, year(o_orderdate) AS o_year FROM orders
    WHERE o_totalprice > 1000 AND o_orderpriority LIKE '1%' AND o_orderdate >= TIMESTAMP '1996-01-01'
""")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    wanted = (F.col("o_totalprice") > 1000) & F.col("o_orderpriority").like("1%") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return orders.where(wanted).select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("long").alias("o_year"))


@query("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name
""")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {x: read_table(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders", "lineitem")}
    first = t["region"].agg(F.min("r_name").alias("r_name"))
    nations = t["nation"].join(t["region"].join(first, "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t["orders"].join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("n_name").agg(total(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


def _outer(how: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        buyers = read_table(spark, sf_dir, "customer").where("c_acctbal > 2000")
        orders = read_table(spark, sf_dir, "orders").where("o_totalprice > 100000")
        return buyers.join(orders, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")

    run.__name__ = f"join_{how}"
    query(f"""
        SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM (SELECT * FROM customer WHERE c_acctbal > 2000)
        {how.upper()} JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON c_custkey = o_custkey
    """)(run)


for _how in ("inner", "left", "right", "full"):
    _outer(_how)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return read_table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return read_table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
    SELECT a.event_id, a.user_id, a.ts AS seen_at, b.ts, b.value
    FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts > b.ts
    WHERE a.event_type = 'view'
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("seen_at"))
    return asof_join(views, events.where("event_type = 'purchase'"), ["user_id"], "seen_at", "ts", ["value"], strict=True, every=10 * 86400)


@query("""
    SELECT p_partkey, band_no FROM part JOIN (SELECT i AS band_no, 900 + 50.0 * i AS low, 900 + 50.0 * i + 75 AS high FROM range(40) t(i))
    ON p_retailprice >= low AND p_retailprice < high
""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = 900 + 50.0 * F.col("id")
    bands = spark.range(40).select(F.col("id").alias("band_no"), low.alias("low"), (low + 75).alias("high"))
    return range_join(read_table(spark, sf_dir, "part"), bands, "p_retailprice", "low", "high", width=75).select("p_partkey", "band_no")


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    WHERE rank <= 3
""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_k_per_group(read_table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return top.select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


_SHARES = """
    SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance,
           grouping(c_nationkey)::TINYINT AS all_nations, grouping(c_mktsegment)::TINYINT AS all_segments FROM customer GROUP BY """


def _grouping(name: str, clause: str) -> None:
    spark_sql(name, ("customer",), _SHARES.replace("::TINYINT", "") + clause, _SHARES + clause)


_grouping("group_rollup", "ROLLUP (c_nationkey, c_mktsegment)")
_grouping("group_cube", "CUBE (c_nationkey, c_mktsegment)")
_grouping("group_sets", "GROUPING SETS ((c_nationkey), (c_mktsegment), ())")


@query("""
    SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
           round(stddev_samp(l_quantity), 6) AS spread, round(corr(l_quantity, l_extendedprice), 6) AS correlation,
           round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(skewness(l_quantity), 6) AS skew
    FROM lineitem GROUP BY l_suppkey
""")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    parts = lines.select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("l_partkey").alias("parts"))
    median = exact_percentile(lines, ["l_suppkey"], "l_extendedprice", 0.5, "median").withColumn("median", F.round("median", 4))
    sums = lines.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("spread"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"),
        F.round(sample_skewness(F.col("l_quantity")), 6).alias("skew"),
    )
    return sums.join(parts, "l_suppkey").join(median, "l_suppkey", "left")


@query("""
    SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 END)::BIGINT AS f, sum(CASE WHEN l_linestatus = 'O' THEN 1 END)::BIGINT AS o
    FROM lineitem GROUP BY l_returnflag
""")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return pivoted.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("""
    SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER t AS quarter,
           lag(o_totalprice) OVER t AS before, lead(o_totalprice) OVER t AS after,
           round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS reached,
           first_value(o_orderkey) OVER t AS first_order, last_value(o_orderkey) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_order,
           round(sum(o_totalprice) OVER (t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three,
           round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW), 4) AS in_90_days
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), t AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    w, t = by.orderBy("o_orderpriority"), by.orderBy("o_orderdate", "o_orderkey")
    near = F.expr("avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.rank().over(w).cast("long").alias("r"),
        F.dense_rank().over(w).cast("long").alias("dr"),
        F.ntile(4).over(t).cast("long").alias("quarter"),
        F.lag("o_totalprice").over(t).alias("before"),
        F.lead("o_totalprice").over(t).alias("after"),
        F.round(F.percent_rank().over(w), 9).alias("share"),
        F.round(F.cume_dist().over(w), 9).alias("reached"),
        F.first_value("o_orderkey").over(t).alias("first_order"),
        F.last_value("o_orderkey").over(t.rowsBetween(0, Window.unboundedFollowing)).alias("last_order"),
        F.round(F.sum("o_totalprice").over(t.rowsBetween(-2, 0)), 2).alias("last_three"),
        F.round(near, 4).alias("in_90_days"),
    )


for _name, _op in (("union_distinct", "UNION"), ("union_all", "UNION ALL"), ("intersect_all", "INTERSECT ALL"), ("except_all", "EXCEPT ALL"), ("intersect_distinct", "INTERSECT"), ("except_distinct", "EXCEPT")):
    spark_sql(_name, ("customer", "supplier"), f"SELECT c_nationkey AS nation FROM customer {_op} SELECT s_nationkey FROM supplier")

@query("""
    SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS dearest FROM customer
    WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 2000)
""")
def subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("customer", "orders"))
    rich = spark.sql("""
        SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS dearest FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
    """)
    return not_in(rich, "c_custkey", read_table(spark, sf_dir, "orders").where("o_totalprice < 2000"), "o_custkey")


@query("""
    SELECT c_custkey, o_orderkey FROM customer,
    LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
    """)
def lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own LATERAL loses the order before LIMIT 1 once orders lie in several partitions, so the first of each customer is ranked here."""
    first = top_k_per_group(read_table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()], 1)
    return read_table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


spark_sql(
    "recursive_cte",
    ("orders",),
    """
    WITH RECURSIVE steps(n, top) AS (SELECT 1, 100000.0D UNION ALL SELECT n + 1, top * 1.5D FROM steps WHERE n < 6)
    SELECT n, count(o_orderkey) AS orders_below FROM steps LEFT JOIN orders ON o_totalprice < top GROUP BY n
    """,
    """
    WITH RECURSIVE steps(n, top) AS (SELECT 1, 100000.0::DOUBLE UNION ALL SELECT n + 1, top * 1.5::DOUBLE FROM steps WHERE n < 6)
    SELECT n, count(o_orderkey) AS orders_below FROM steps LEFT JOIN orders ON o_totalprice < top GROUP BY n
    """,
)


@query(r"""
    SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, reverse(p_brand) AS rev, split_part(p_type, ' ', 1) AS kind,
           regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, lpad(p_brand, 12, '*') AS padded, concat(p_brand, NULL, '-', p_size) AS tag,
           levenshtein(p_name, p_type) AS distance, p_size / nullif(p_size % 3, 0) AS ratio,
           lower(p_type) AS low, replace(p_name, 'a', 'AA') AS replaced, trim('  ' || p_brand || ' ') AS trimmed, instr(p_name, 'e') AS e_at,
           substring(p_name, 2, 3) AS middle, CASE WHEN p_size % 2 = 0 THEN substring(p_name, 0, 3) ELSE substring(p_name, -3, 2) END AS edge,
           starts_with(p_type, 'S') AS with_s, contains(p_name, 'o') AS with_o, repeat(left(p_brand, 1), 3) AS thrice, ascii(p_brand) AS code
    FROM part
""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.length("p_name").cast("long").alias("len"),
        F.reverse("p_brand").alias("rev"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"),
        F.regexp_replace("p_name", "[aeiou]", "_").alias("masked"),
        F.lpad("p_brand", 12, "*").alias("padded"),
        concat_skipping_nulls(F.col("p_brand"), F.lit(None), F.lit("-"), F.col("p_size")).alias("tag"),
        F.levenshtein("p_name", "p_type").cast("long").alias("distance"),
        divide_or_null(F.col("p_size"), F.col("p_size") % 3).alias("ratio"),
        F.lower("p_type").alias("low"),
        F.replace("p_name", F.lit("a"), F.lit("AA")).alias("replaced"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.instr("p_name", "e").cast("long").alias("e_at"),
        F.substring("p_name", 2, 3).alias("middle"),
        F.when(F.col("p_size") % 2 == 0, substring_from(F.col("p_name"), 0, 3)).otherwise(substring_from(F.col("p_name"), -3, 2)).alias("edge"),
        F.startswith("p_type", F.lit("S")).alias("with_s"),
        F.contains("p_name", F.lit("o")).alias("with_o"),
        F.repeat(F.left("p_brand", F.lit(1)), 3).alias("thrice"),
        F.ascii("p_brand").alias("code"),
    )


@query("""
    SELECT date_trunc('month', ts) AS month, dayofweek(ts) AS dow, hour(ts) AS hour, week(ts) AS week, date_diff('day', DATE '2024-01-01', ts::DATE) AS days,
           last_day(ts) AS month_end, count(*) AS n, round(avg(json_extract_string(props, '$.k')::DOUBLE), 6) AS mean_k
    FROM events GROUP BY ALL
""")
def dates_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    by = [F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), day_of_week(F.col("ts")).alias("dow"), F.hour("ts").cast("long").alias("hour")]
    by += [F.weekofyear("ts").cast("long").alias("week"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"), F.last_day("ts").alias("month_end")]
    k = F.get_json_object("props", "$.k").cast("double")
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(k), 6).alias("mean_k"))


@query("""
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]), 9) AS alike
    FROM embeddings ORDER BY alike DESC, vec_id LIMIT 10
""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    wanted = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("wanted"))  # one row
    alike = F.round(cosine(F.col("embedding"), F.col("wanted")), 9).alias("alike")
    return vectors.crossJoin(F.broadcast(wanted)).select("vec_id", alike).orderBy(F.col("alike").desc(), "vec_id").limit(10)


@query("""
    SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY ALL
""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_totals(read_table(spark, sf_dir, "events"), "6 hours")


@query("""
    SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 2) AS total FROM (
        SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, no
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_totals(read_table(spark, sf_dir, "events"), "30 minutes")


@query("""
    SELECT event_id, 1 + sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOURS THEN 1 ELSE 0 END AS opens FROM events)
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(read_table(spark, sf_dir, "events"), ["user_id"], "ts", 12 * 3600, tie=["event_id"], every=10 * 86400).select("event_id", "session_no")
