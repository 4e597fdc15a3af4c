"""Written tables."""

import time

from pyspark.sql import functions as F

from netloom.plans.store import WRITING, written


def _last_plan(spark) -> str:
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    return done.apply(done.size() - 1).physicalPlanDescription()


def _shuffled(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().iterator()
    found = 0
    while blocks.hasNext():
        found += blocks.next().isShuffle()
    return found


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    t = written(spark.range(3_000_000).select(F.col("id").alias("k"), F.lit("constant").alias("a"), F.lit(7).alias("b")), "t")
    few = written(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("c")), "few")
    big = written(spark.range(3_000_000).select((F.col("id") * 3).alias("k"), F.xxhash64("id").alias("h"), F.xxhash64("id", "id").alias("g")), "big")
    assert written(big.join(t, "k"), "joined").count() == 1_000_000
    written(big.join(t, "k"), "joined")
    assert "BroadcastExchange" not in _last_plan(spark)
    written(big.join(few, "k"), "joined")
    assert "BroadcastExchange" in _last_plan(spark)
    assert all(spark.conf.get(k, None) is None for k in WRITING)


def test_what_a_step_shuffles_goes_with_its_end(spark):
    was = _shuffled(spark)
    t = written(spark.range(100_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s")), "sums")
    until = time.monotonic() + 10
    while _shuffled(spark) > was and time.monotonic() < until:
        time.sleep(0.1)
    assert _shuffled(spark) <= was
    assert t.count() == 10
