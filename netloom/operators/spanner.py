"""Spanners of clusters: nodes join centers next to them, and only the edges that joined them and one to each neighbouring cluster stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import deleted, written
from . import graph


def clusters(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """problem_id, node_id, cluster, edge_id: a center (problem_id, node_id) is its own cluster, a node next to centers joins the least, by its
    least edge; any other is alone. One join and one minimum, however large a hub is."""
    both = graph.undirected(edges).where("src <> dst")
    at = centers.select("problem_id", F.col("node_id").alias("dst")).distinct()
    joined = both.join(at, ["problem_id", "dst"]).groupBy("problem_id", F.col("src").alias("node_id")).agg(F.min(F.struct("dst", "edge_id")).alias("best"))
    nodes = edges.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    own = centers.select("problem_id", "node_id", F.lit(True).alias("center")).distinct()
    out = nodes.join(own, ["problem_id", "node_id"], "left").join(joined, ["problem_id", "node_id"], "left")
    member = F.col("center").isNull() & F.col("best").isNotNull()
    return out.select("problem_id", "node_id", F.when(member, F.col("best.dst")).otherwise(F.col("node_id")).alias("cluster"), F.when(member, F.col("best.edge_id")).alias("edge_id"))


def cluster_spanner(edges: DataFrame, found: DataFrame) -> DataFrame:
    """problem_id, edge_id: the edges by which nodes joined, and of each node's edges to another cluster the least."""
    both = graph.undirected(edges).where("src <> dst")
    side = lambda c, n: found.select("problem_id", F.col("node_id").alias(c), F.col("cluster").alias(n))
    across = both.join(side("src", "own"), ["problem_id", "src"]).join(side("dst", "other"), ["problem_id", "dst"]).where("own <> other")
    links = across.groupBy("problem_id", "src", "other").agg(F.min("edge_id").alias("edge_id"))
    return found.where("edge_id IS NOT NULL").select("problem_id", "edge_id").unionByName(links.select("problem_id", "edge_id")).distinct()


def next_level(edges: DataFrame, found: DataFrame, length: str = "length") -> DataFrame:
    """The graph of the clusters: the shortest edge between each two."""
    return graph.contract(edges, found.select("problem_id", "node_id", F.col("cluster").alias("image")), length)


def steps(found: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, edge_id, within: edges with both ends in one cluster, and over how many spanner edges their ends are joined (at most 2)."""
    side = lambda c, n, by: found.select("problem_id", F.col("node_id").alias(c), F.col("cluster").alias(n), F.col("edge_id").alias(by))
    e = edges.select("problem_id", "edge_id", "src", "dst").join(side("src", "a", "by_a"), ["problem_id", "src"]).join(side("dst", "b", "by_b"), ["problem_id", "dst"])
    return e.where("a = b AND src <> dst").select("problem_id", "edge_id", (F.col("by_a").isNotNull().cast("bigint") + F.col("by_b").isNotNull().cast("bigint")).alias("within"))


def pruned(edges: DataFrame, most: int, order: str = "edge_id") -> DataFrame:
    """At most so many edges of each problem, the first by order."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("problem_id").orderBy(order))
    return edges.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def random_forest(nodes: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """A spanning forest under random edge lengths, the same for the same seed."""
    shuffled = edges.withColumn("length", F.xxhash64("edge_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double"))
    return graph.spanning_forest(nodes, shuffled)


def embedding(edges: DataFrame, found: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """problem_id, edge_id, k, step_edge, step_direction: for each edge between two nodes the path of 1 to 3 edges of the cluster spanner from its
    tail to its head. found: clusters(); kept: their cluster_spanner(), where it is known already.

    An edge of the spanner is its own path. Within a cluster a path leads over the center. Between clusters it takes the tail's own link to the
    head's cluster, and from where that ends, by way of the center, goes on to the head. So every path comes from lookups: no search widens at hubs. The way of a joining edge is looked up once for each node, not
    for each edge that leads over it."""
    e = edges.where("src <> dst").select("problem_id", "edge_id", "src", "dst")
    # The way of a joining edge from its node to the center is that of the edge if the node is its tail.
    tails = edges.select("problem_id", "edge_id", F.col("src").alias("_s"))
    way = F.when(F.col("edge_id").isNotNull(), F.when(F.col("_s") == F.col("node_id"), 1).otherwise(-1))
    # Only from nodes that are some edge's tail are links asked for.
    asked = e.select("problem_id", F.col("src").alias("node_id"), F.lit(True).alias("asked")).distinct()
    ways = found.join(tails, ["problem_id", "edge_id"], "left").select("problem_id", "node_id", "cluster", "edge_id", way.alias("way"))
    known = written(ways.join(asked, ["problem_id", "node_id"], "left"), "joined-nodes")
    at = lambda c, n: known.select("problem_id", F.col("node_id").alias(c), *[F.col(x).alias(f"{n}_{y}") for x, y in (("cluster", "cluster"), ("edge_id", "edge"), ("way", "way"))])
    asking = known.where("asked").select("problem_id", F.col("node_id").alias("src"), F.col("cluster").alias("own_cluster"))
    both = graph.undirected(e).where("src <> dst").join(asking, ["problem_id", "src"]).join(at("dst", "other"), ["problem_id", "dst"])
    links = both.where("own_cluster <> other_cluster").groupBy("problem_id", "src", F.col("other_cluster").alias("head_cluster"))
    links = links.agg(F.min(F.struct(F.col("edge_id").alias("link"), F.col("direction").alias("link_way"), F.col("dst").alias("through"), F.col("other_edge").alias("through_edge"), F.col("other_way").alias("through_way"))).alias("l"))
    links = written(links.select("problem_id", "src", "head_cluster", "l.*"), "links")
    t = e.join(at("src", "tail"), ["problem_id", "src"]).join(at("dst", "head"), ["problem_id", "dst"]).join(links, ["problem_id", "src", "head_cluster"], "left")
    t = t.join((cluster_spanner(edges, known) if kept is None else kept).withColumn("kept", F.lit(True)), ["problem_id", "edge_id"], "left")
    step = lambda edge, way: F.struct(F.col(edge).alias("step_edge"), way.cast("int").alias("step_direction"))
    own = F.array(step("edge_id", F.lit(1)))
    within = F.array(step("tail_edge", F.col("tail_way")), step("head_edge", -F.col("head_way")))
    across = F.array(step("link", F.col("link_way")), step("through_edge", F.col("through_way")), step("head_edge", -F.col("head_way")))
    # A link that already ends at the head needs no way over the center.
    across = F.when(F.col("through") == F.col("dst"), F.slice(across, 1, 1)).otherwise(across)
    steps = F.when(F.col("kept"), own).when(F.col("tail_cluster") == F.col("head_cluster"), within).otherwise(across)
    steps = F.filter(steps, lambda s: s.step_edge.isNotNull())
    out = written(t.select("problem_id", "edge_id", F.posexplode(steps).alias("k", "s")).select("problem_id", "edge_id", "k", "s.*"), "embedding")
    deleted(known, links)
    return out
