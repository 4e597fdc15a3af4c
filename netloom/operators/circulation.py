"""Circulations split into closed walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import deleted, written

#: Groups into which the units at a node are dealt before they are numbered.
GROUPS = 64


def _numbered(units: DataFrame, node: str) -> DataFrame:
    """units with their place i at a node, by (edge_id mod GROUPS, edge_id, unit): each group is numbered for itself, then begins where the last ended."""
    t = units.withColumn("_group", F.pmod("edge_id", F.lit(GROUPS)))
    size = t.groupBy("problem_id", node, "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("problem_id", node).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("problem_id", node, "_group").orderBy("edge_id", "unit"))
    return t.withColumn("_i", inside).join(size, ["problem_id", node, "_group"]).withColumn("i", F.col("_i") + F.col("_before")).drop("_i", "_before", "_group")


def closed_walks(edges: DataFrame, flow: str = "flow") -> DataFrame:
    """problem_id, edge_id, unit, walk: every unit of a circulation (problem_id, edge_id, src, dst, whole flow of 0 or more) in a closed walk, named by
    its least (edge_id, unit). The i-th unit into a node goes on as the i-th unit out of it, so walks are the circles of a
    permutation, and pointer doubling finds the least unit of each in about log2(length) joins. The rows are the units of flow.

    Units that enter or leave a node out of balance belong to no walk; they raise an error."""
    units = edges.where(F.col(flow) > 0).select("problem_id", "edge_id", "src", "dst", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(flow).cast("bigint"))).alias("unit"))
    units = written(units, "units")
    into = _numbered(units.select("problem_id", "edge_id", "unit", F.col("dst").alias("node_id")), "node_id")
    out = _numbered(units.select("problem_id", F.col("edge_id").alias("next_edge"), F.col("unit").alias("next_unit"), F.col("src").alias("node_id")).withColumnsRenamed({"next_edge": "edge_id", "next_unit": "unit"}), "node_id")
    out = out.select("problem_id", "node_id", "i", F.col("edge_id").alias("next_edge"), F.col("unit").alias("next_unit"))
    paired = into.join(out, ["problem_id", "node_id", "i"], "full")
    fits = paired.select("problem_id", F.when(F.col("edge_id").isNull() | F.col("next_edge").isNull(), F.raise_error(F.lit("the flow isn't balanced at every node"))).otherwise(F.col("edge_id")).cast("bigint").alias("edge_id"), "unit", "next_edge", "next_unit")
    now = written(fits.withColumn("walk", F.struct("edge_id", "unit")), "walks")
    while True:
        r = now.select("problem_id", F.col("edge_id").alias("next_edge"), F.col("unit").alias("next_unit"), F.col("next_edge").alias("_e"), F.col("next_unit").alias("_u"), F.col("walk").alias("_walk"))
        then = now.drop("moved").join(r, ["problem_id", "next_edge", "next_unit"])
        then = written(then.select("problem_id", "edge_id", "unit", F.col("_e").alias("next_edge"), F.col("_u").alias("next_unit"), F.least("walk", "_walk").alias("walk"), (F.col("_walk") < F.col("walk")).alias("moved")), "walks")
        deleted(now)
        now = then
        if not now.where("moved").take(1):  # a doubling that lowers no unit's least has seen every circle whole
            deleted(units)
            return now.select("problem_id", "edge_id", "unit", "walk")


def walk_sums(walks: DataFrame, values: DataFrame) -> DataFrame:
    """problem_id, walk, units, cost, length of each closed walk; values: problem_id, edge_id, cost, length."""
    v = walks.join(values.select("problem_id", "edge_id", "cost", "length"), ["problem_id", "edge_id"])
    return v.groupBy("problem_id", "walk").agg(F.count("*").alias("units"), F.sum("cost").alias("cost"), F.sum("length").alias("length"))
