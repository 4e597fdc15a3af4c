"""Breadth-first levels kept under batches of deletions: only nodes whose way to the root is lost are joined again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import deleted, released, written
from . import trees

_STATE = ["problem_id", "node_id", "parent", "parent_edge", "depth"]


@dataclass
class Levels:
    #: problem_id, edge_id, src, dst that are left.
    edges: DataFrame
    #: problem_id, node_id, parent, parent_edge, depth; nodes that no root reaches any more are gone.
    tree: DataFrame
    #: Nodes that the last batch gave another parent or depth, or took out.
    touched: int


def levels(edges: DataFrame, roots: DataFrame) -> Levels:
    edges = edges.select("problem_id", "edge_id", "src", "dst")
    tree = trees.breadth_first(edges, roots).select(*_STATE)
    return Levels(edges, tree, tree.count())


def deletions(now: Levels, batch: DataFrame) -> Levels:
    """The levels after the edges of batch (problem_id, edge_id) are gone; edges that are not there count for nothing.

    A node whose parent edge is gone looks for a neighbour one level above that has kept its level. If there is none, the node has lost its level, and
    its children look in turn. Then nodes that lost theirs are reached again, level by level, from those that kept theirs. All joins start from
    these nodes; the rest of the table is written once at the end."""
    batch = batch.select("problem_id", "edge_id").distinct()
    edges = written(now.edges.join(batch, ["problem_id", "edge_id"], "left_anti"), "edges-left")
    key = ["problem_id", "node_id"]
    arcs = trees.held_arcs(edges, only=[*key, "to", "edge_id"])
    cut = batch.withColumnRenamed("edge_id", "parent_edge")
    asking = written(now.tree.join(cut, ["problem_id", "parent_edge"], "left_semi").select(*key, "depth"), "asking")
    lost_parts, moved = [], now.tree.select(*_STATE).limit(0)
    while asking.take(1):
        lost = reduce(DataFrame.unionByName, lost_parts) if lost_parts else None
        above = now.tree.select("problem_id", F.col("node_id").alias("to"), F.col("depth").alias("_depth"))
        offers = asking.join(arcs, key).join(above, ["problem_id", "to"]).where("_depth = depth - 1")
        if lost is not None:
            offers = offers.join(lost.select("problem_id", F.col("node_id").alias("to")), ["problem_id", "to"], "left_anti")
        # A neighbour that asks in the same round may lose its level yet; its children, this node among them, then ask again.
        best = offers.groupBy(*key).agg(F.min(F.struct(F.col("to").alias("parent"), F.col("edge_id").alias("parent_edge"))).alias("b"), F.first("depth").alias("depth"))
        best = written(best.select(*key, "b.parent", "b.parent_edge", "depth"), "new-parents")
        new = written(asking.join(best, key, "left_anti").select(*key, "depth"), "lost")
        lost_parts.append(new)
        kept = moved.join(asking.select(*key), key, "left_anti").unionByName(best)
        moved = written(kept, "moved")
        # Children under the pointers of now: those that moved count by their new parent only.
        gone = new.select("problem_id", F.col("node_id").alias("parent"))
        still = now.tree.join(gone, ["problem_id", "parent"], "left_semi").join(moved.select(*key), key, "left_anti")
        children = still.select(*key, "depth").unionByName(moved.join(gone, ["problem_id", "parent"], "left_semi").select(*key, "depth"))
        asking = written(children.join(reduce(DataFrame.unionByName, lost_parts).select(*key), key, "left_anti").distinct(), "asking")
    if not lost_parts:
        released(arcs)
        return Levels(edges, now.tree, 0)
    lost = written(reduce(DataFrame.unionByName, lost_parts).select(*key).distinct(), "lost")
    kept = now.tree.join(lost, key, "left_anti").join(moved.select(*key), key, "left_anti").unionByName(moved.join(lost, key, "left_anti"))
    # Offers from kept nodes next to lost ones, then within the lost ones, each round to those that got a lower level.
    inner = written(arcs.join(lost, key, "left_semi"), "lost-arcs")
    edge = inner.join(kept.select("problem_id", F.col("node_id").alias("to"), F.col("depth").alias("_depth")), ["problem_id", "to"])
    offer = lambda t: t.groupBy(*key).agg(F.min(F.struct((F.col("_depth") + 1).alias("depth"), F.col("to").alias("parent"), F.col("edge_id").alias("parent_edge"))).alias("o"))
    found = written(offer(edge).withColumn("new", F.lit(True)), "found")
    while found.where("new").take(1):
        front = found.where("new").select("problem_id", F.col("node_id").alias("to"), F.col("o.depth").alias("_depth"))
        more = offer(inner.join(front, ["problem_id", "to"])).withColumnRenamed("o", "_o")
        both = found.drop("new").join(more, key, "full")
        better = F.col("o").isNull() | F.coalesce(F.col("_o") < F.col("o"), F.lit(False))
        lower = F.col("o").isNull() | F.coalesce(F.col("_o.depth") < F.col("o.depth"), F.lit(False))
        then = written(both.select(*key, F.when(better, F.col("_o")).otherwise(F.col("o")).alias("o"), lower.alias("new")), "found")
        deleted(found)
        found = then
    tree = written(kept.select(*_STATE).unionByName(found.select(*key, "o.parent", "o.parent_edge", "o.depth").select(*_STATE)), "levels")
    touched = lost.count() + moved.join(lost, key, "left_anti").count()
    released(arcs)
    deleted(inner, found, lost)
    return Levels(edges, tree, touched)
