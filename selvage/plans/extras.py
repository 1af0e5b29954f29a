"""Native extras over the star tables: joins, grouping sets, set operations, maps, dates (not claimed as parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.plans.registry import query
from selvage.tables import table

def _revenue() -> F.Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")  # fmt: skip
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(_revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("shipping_priority", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")  # fmt: skip
def shipping_priority(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, sf, "lineitem").join(o, "l_orderkey").groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))
    return rows.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("supplier_volume", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'ASIA' GROUP BY n_name""")  # fmt: skip
def supplier_volume(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    n = table(spark, sf, "nation").join(r, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, sf, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return table(spark, sf, "lineitem").join(s, "l_suppkey").groupBy("n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


@query("order_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("order_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def order_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")]], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("idle_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def idle_customers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("monthly_pivot", """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def monthly_pivot(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda x: F.count_if(F.col("o_orderstatus") == x).alias(x.lower())
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(s("F"), s("O"), s("P"))


@query("top_parts", "SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 3")
def top_parts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(w).alias("r")).where("r <= 3")


@query("balance_ranks", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quartile, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS share, round(c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 2) AS step FROM customer")
def balance_ranks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey")
    by, full = w.orderBy("c_acctbal"), w.orderBy("c_acctbal", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.ntile(4).over(full).alias("quartile"), F.round(F.percent_rank().over(by), 6).alias("share"), F.round(F.col("c_acctbal") - F.lag("c_acctbal").over(full), 2).alias("step"))


@query("shared_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("event_properties", "SELECT event_type, avg((props->>'$.k')::INT) AS k, list_sort(list(DISTINCT (props->>'$.k')::INT % 3)) AS residues FROM events GROUP BY event_type")
def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.avg(k).alias("k"), F.sort_array(F.collect_set(k % 3)).alias("residues"))


@query("approximate_users")
def approximate_users(spark: SparkSession, sf: str) -> DataFrame:
    """Sketch: distinct users by kind, approximate by nature."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("users"), F.percentile_approx("value", 0.5, 10000).alias("median"))
