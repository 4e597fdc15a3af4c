"""Graphs built from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_line(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Days of events as nodes that should end with equal loads; neighbouring days exchange events at cost 1 + day mod 3."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    one = Window.partitionBy(F.lit(0))  # as many rows as days
    n = days.select((F.row_number().over(one.orderBy("day")) - 1).cast("bigint").alias("d"), "c", F.sum("c").over(one).alias("tot"), F.count("*").over(one).alias("k"))
    n = n.select(F.lit("days").alias("problem_id"), F.col("d").alias("node_id"), F.expr("tot * (d + 1) div k - tot * d div k - c").cast("bigint").alias("demand"), "tot", "k")
    ahead = n.where("node_id < k - 1").select("problem_id", (2 * F.col("node_id")).alias("edge_id"), F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"), F.lit(0).cast("bigint").alias("lower"), F.col("tot").alias("upper"), (1 + F.col("node_id") % 3).alias("cost"))
    back = ahead.select("problem_id", (F.col("edge_id") + 1).alias("edge_id"), F.col("dst").alias("src"), F.col("src").alias("dst"), "lower", "upper", "cost")
    return n.select("problem_id", "node_id", "demand"), ahead.unionByName(back)


#: Columns of an edge for each row of lineitem, in SQL that Spark and DuckDB share.
LINE_EDGE = {
    "problem_id": "CAST(l_suppkey % 10 AS STRING)",
    "edge_id": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey",
    "src": "l_suppkey",
    "dst": "1000000 + l_partkey",
    "lower": "CAST(l_quantity AS BIGINT) % 3",
    "upper": "CAST(l_quantity AS BIGINT) + 3",
    "cost": "CAST(l_linenumber AS BIGINT) * 2 - 5",
    "flow": "CAST(l_quantity AS BIGINT) % 3 + CAST(l_quantity AS BIGINT) % 4",
}
LINE_EDGE_SQL = "e AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in LINE_EDGE.items()) + " FROM lineitem)"


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in LINE_EDGE.items()])


def order_lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A problem for each nation: two nodes, a parallel edge for each order of its customers, capacity by its date's day, cost by
    its price; half of all capacity is demanded."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = orders.select(
        F.col("c_nationkey").cast("string").alias("problem_id"), F.col("o_orderkey").alias("edge_id"), F.lit(0).cast("bigint").alias("src"), F.lit(1).cast("bigint").alias("dst"),
        F.lit(0).cast("bigint").alias("lower"), F.dayofmonth("o_orderdate").cast("bigint").alias("upper"), F.floor("o_totalprice").cast("bigint").alias("cost"),
    )
    half = e.groupBy("problem_id").agg(F.expr("sum(upper) div 2").cast("bigint").alias("half"))
    nodes = half.select("problem_id", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("node_id"), (-F.col("half")).alias("demand")), F.struct(F.lit(1).cast("bigint").alias("node_id"), F.col("half").alias("demand")))).alias("n")).select("problem_id", "n.*")
    return nodes, e


def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst (regions of supplier and customer) and capacity (lines shipped), all pairs."""
    t = lambda n: table(spark, sf_dir, n)
    supplier = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").cast("bigint").alias("src"))
    customer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("bigint").alias("dst"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    # Distinct capacities make minimum cuts unique.
    counted = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counted.select(F.lit("regions").alias("problem_id"), (F.col("src") * 5 + F.col("dst")).alias("edge_id"), "src", "dst", (F.col("n") * 64 + F.col("src") * 5 + F.col("dst")).alias("capacity"))


REGION_SQL = """r AS (
  SELECT CAST(ns.n_regionkey AS BIGINT) AS src, CAST(nc.n_regionkey AS BIGINT) AS dst, CAST(count(*) * 64 + any_value(ns.n_regionkey) * 5 + any_value(nc.n_regionkey) AS BIGINT) AS capacity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey GROUP BY 1, 2)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: types of consecutive events of a user, by rank of the type's name; cost: 7 less the count modulo 13."""
    e = table(spark, sf_dir, "events")
    rank = e.select("event_type").distinct().select("event_type", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("event_type")).cast("bigint").alias("k"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.select("event_type", F.lead("event_type").over(w).alias("next")).where("next IS NOT NULL").groupBy("event_type", "next").agg(F.count("*").alias("n"))
    steps = steps.join(rank.withColumnRenamed("k", "src"), "event_type").join(rank.select(F.col("event_type").alias("next"), F.col("k").alias("dst")), "next")
    return steps.select(F.lit("events").alias("problem_id"), (F.col("src") * 100 + F.col("dst")).alias("edge_id"), "src", "dst", (F.col("n") % 13 - 3).alias("cost"), "n")


TRANSITION_SQL = """k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
s AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
t AS (SELECT a.k AS src, b.k AS dst, CAST(count(*) % 13 - 3 AS BIGINT) AS cost, count(*) AS n FROM s JOIN k a ON a.event_type = s.event_type JOIN k b ON b.event_type = s.nxt GROUP BY 1, 2)"""
