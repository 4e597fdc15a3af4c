"""Synthetic workloads as tables: every value is a hash of its ids, so that they need no state and scale out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def drawn(low: int, high: int, *ids) -> Column:
    """A whole number from low to high, by hash."""
    return (F.pmod(F.xxhash64(*ids), F.lit(high - low + 1)) + low).cast("bigint")


def _edges(df: DataFrame, name: str, src: Column, dst: Column, upper: Column, cost: Column, lower: Column | None = None) -> DataFrame:
    low = lower if lower is not None else F.lit(0)
    return df.select(F.lit(name).alias("problem_id"), F.col("id").alias("edge_id"), src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), low.cast("bigint").alias("lower"), upper.cast("bigint").alias("upper"), cost.cast("bigint").alias("cost"))


def _nodes(spark: SparkSession, name: str, n: int, demand: Column) -> DataFrame:
    return spark.range(n).select(F.lit(name).alias("problem_id"), F.col("id").alias("node_id"), demand.cast("bigint").alias("demand"))


def crew_scheduling(spark: SparkSession, flights: int = 500, crews: int = 60, links: int = 5) -> tuple[DataFrame, DataFrame]:
    """Each flight (2f to 2f + 1) is flown once; crews leave the base, connect later flights and return."""
    base = 2 * flights
    fly = _edges(spark.range(flights), "crew", 2 * F.col("id"), 2 * F.col("id") + 1, F.lit(1), F.lit(0), F.lit(1))
    n = flights * links
    f = F.floor(F.col("id") / links)
    later = f + 1 + F.pmod(F.xxhash64("id", F.lit("later")), F.lit(20))
    connect = _edges(spark.range(n), "crew", 2 * f + 1, 2 * later, F.lit(1), drawn(10, 90, "id", F.lit("wait"))).withColumn("edge_id", F.col("edge_id") + flights).where(F.col("dst") < base)
    out = _edges(spark.range(flights), "crew", F.lit(base), 2 * F.col("id"), F.lit(1), drawn(100, 300, "id", F.lit("out"))).withColumn("edge_id", F.col("edge_id") + flights + n)
    back = _edges(spark.range(flights), "crew", 2 * F.col("id") + 1, F.lit(base + 1), F.lit(1), drawn(100, 300, "id", F.lit("back"))).withColumn("edge_id", F.col("edge_id") + 2 * flights + n)
    home = _edges(spark.range(1), "crew", F.lit(base + 1), F.lit(base), F.lit(flights), F.lit(crews)).withColumn("edge_id", F.lit(3 * flights + n).cast("bigint"))
    return _nodes(spark, "crew", base + 2, F.lit(0)), fly.unionByName(connect).unionByName(out).unionByName(back).unionByName(home)


def arbitrage(spark: SparkSession, markets: int = 1000, trades: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """A circulation over markets whose trades gain or cost."""
    e = _edges(spark.range(trades), "arbitrage", drawn(0, markets - 1, "id", F.lit("u")), drawn(0, markets - 1, "id", F.lit("v")), drawn(1, 20, "id", F.lit("cap")), drawn(-10, 40, "id", F.lit("cost")))
    return _nodes(spark, "arbitrage", markets, F.lit(0)), e.where("src <> dst")


def slotting(spark: SparkSession, items: int = 2000, slots: int = 2000, per_item: int = 100) -> DataFrame:
    """problem_id, left, right, weight: items, the slots that they fit and the walk to each; a pair may come twice."""
    e = spark.range(items * per_item)
    return e.select(F.lit("slots").alias("problem_id"), F.floor(F.col("id") / per_item).cast("bigint").alias("left"), (drawn(0, slots - 1, "id", F.lit("slot")) + items).alias("right"), drawn(1, 500, "id", F.lit("walk")).alias("weight"))


def telecom(spark: SparkSession, routers: int = 5000, links: int = 4, demand: int = 50) -> tuple[DataFrame, DataFrame]:
    """A ring of routers with random links; the first sends to the middle one."""
    ring = _edges(spark.range(routers), "telecom", F.col("id"), (F.col("id") + 1) % routers, F.lit(10 * demand), drawn(1, 10, "id"))
    more = _edges(spark.range(routers * links), "telecom", F.floor(F.col("id") / links), drawn(0, routers - 1, "id", F.lit("to")), drawn(1, 100, "id", F.lit("cap")), drawn(1, 30, "id", F.lit("cost")))
    more = more.where("src <> dst").withColumn("edge_id", F.col("edge_id") + routers)
    ends = F.when(F.col("id") == 0, -demand).when(F.col("id") == routers // 2, demand).otherwise(0)
    return _nodes(spark, "telecom", routers, ends), ring.unionByName(more)
