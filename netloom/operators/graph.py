"""Operators on graphs as joins and aggregates: views, shortest paths, components, trees, cycles, contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import deleted, written


#: Rows that share a key before a join sends them where they are, by a broadcast, in place of to one task.
HOT = 100_000


def residual(edges: DataFrame, flows: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """problem_id, edge_id, src, dst, capacity, cost, direction: arcs along which flow can still change."""
    f = edges.join(flows, ["problem_id", "edge_id"], "left").withColumn("flow", F.coalesce("flow", "lower"))
    ahead = f.select("problem_id", "edge_id", "src", "dst", (F.col("upper") - F.col("flow")).alias("capacity"), "cost", F.lit(1).alias("direction"))
    back = f.select("problem_id", "edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("flow") - F.col("lower")).alias("capacity"), (-F.col("cost")).alias("cost"), F.lit(-1).alias("direction"))
    return ahead.unionByName(back).where(F.col("capacity") > epsilon)


def imbalance(nodes: DataFrame, edges: DataFrame, flows: DataFrame) -> DataFrame:
    """problem_id, node_id, missing: demand less net inflow."""
    f = edges.join(flows, ["problem_id", "edge_id"])
    ends = f.select("problem_id", F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.col("flow").alias("d")), F.struct(F.col("src").alias("node_id"), (-F.col("flow")).alias("d")))).alias("x"))
    net = ends.groupBy("problem_id", "x.node_id").agg(F.sum("x.d").alias("net"))
    return nodes.join(net, ["problem_id", "node_id"], "left").select("problem_id", "node_id", (F.col("demand") - F.coalesce("net", F.lit(0))).alias("missing"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, a self-loop once."""
    cols = ["problem_id", "edge_id"]
    ahead = edges.select(*cols, "src", "dst", F.lit(1).alias("direction"))
    return ahead.unionByName(edges.where("src <> dst").select(*cols, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).alias("direction")))


def incidence(edges: DataFrame) -> DataFrame:
    """Coordinates of the incidence matrix: -1 at the tail, 1 at the head."""
    return edges.select("problem_id", F.explode(F.array(F.struct(F.col("src").alias("row"), F.lit(-1).alias("value")), F.struct(F.col("dst").alias("row"), F.lit(1).alias("value")))).alias("x"), F.col("edge_id").alias("col")).select("problem_id", "x.row", "col", "x.value")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("problem_id", "node_id").agg(F.count("*").alias("degree"))


def contract(edges: DataFrame, mapping: DataFrame, length: str = "length") -> DataFrame:
    """Edges between the images of nodes (mapping: problem_id, node_id, image): loops go, the shortest of each pair stays."""
    to = lambda c, n: mapping.select("problem_id", F.col("node_id").alias(c), F.col("image").alias(n))
    e = edges.join(to("src", "u"), ["problem_id", "src"]).join(to("dst", "v"), ["problem_id", "dst"]).where("u <> v")
    return e.groupBy("problem_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(length).alias(length), F.min_by("edge_id", F.struct(length, "edge_id")).alias("edge_id"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    keep = lambda c: nodes.select("problem_id", F.col("node_id").alias(c))
    return edges.join(keep("src"), ["problem_id", "src"], "left_semi").join(keep("dst"), ["problem_id", "dst"], "left_semi")


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str = "cost", rounds: int | None = None) -> DataFrame:
    """problem_id, node_id, distance from the nearest source (problem_id, node_id), for what can be reached.

    Rounds of relaxation, each a join and a minimum, until none improves, or as many as given (the nodes less one by then
    suffice); improvements that never end mean a negative cycle, and stop there."""
    arcs = edges.select("problem_id", F.col("src").alias("node_id"), F.col("dst").alias("to"), F.col(weight).alias("w"))
    known = written(sources.select("problem_id", "node_id", F.lit(0).cast("bigint").alias("distance")).distinct(), "distances")
    limit = rounds if rounds is not None else edges.select(F.explode(F.array("src", "dst")).alias("v"), "problem_id").distinct().groupBy("problem_id").count().agg(F.max("count")).first()[0] or 1
    front = known
    for _ in range(max(0, limit - (rounds is None))):
        offers = arcs.join(front, ["problem_id", "node_id"]).groupBy("problem_id", F.col("to").alias("node_id")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        new = known.join(offers, ["problem_id", "node_id"], "full").select("problem_id", "node_id", F.least("distance", "offer").cast("bigint").alias("distance"), (F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).alias("changed"))
        new = written(new.withColumn("changed", F.coalesce("changed", F.lit(False))), "distances")
        known, front = new.select("problem_id", "node_id", "distance"), new.where("changed").select("problem_id", "node_id", "distance")
        if not front.take(1):
            break
    return known


def hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Breadth-first levels."""
    return shortest_paths(edges.withColumn("one", F.lit(1).cast("bigint")), sources, "one")


def has_negative_cycle(edges: DataFrame, weight: str = "cost") -> DataFrame:
    """problem_id, negative_cycle: whether relaxation from all nodes at 0 still improves after as many rounds as nodes."""
    nodes = written(edges.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "nodes")
    arcs = edges.select("problem_id", F.col("src").alias("node_id"), F.col("dst").alias("to"), F.col(weight).alias("w"))
    known = nodes.withColumn("distance", F.lit(0).cast("bigint")).withColumn("changed", F.lit(True))
    for _ in range(nodes.groupBy("problem_id").count().agg(F.max("count")).first()[0] or 0):
        offers = arcs.join(known.where("changed").select("problem_id", "node_id", "distance"), ["problem_id", "node_id"]).groupBy("problem_id", F.col("to").alias("node_id")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        known = known.select("problem_id", "node_id", "distance").join(offers, ["problem_id", "node_id"], "left")
        known = written(known.select("problem_id", "node_id", F.least("distance", "offer").alias("distance"), F.coalesce(F.col("offer") < F.col("distance"), F.lit(False)).alias("changed")), "distances")
        if not known.where("changed").take(1):
            break
    return known.groupBy("problem_id").agg(F.max("changed").alias("negative_cycle"))


def first_negative_edge(edges: DataFrame) -> DataFrame:
    """problem_id, src, dst, edge_id of the negative edge with the least id."""
    return edges.where("cost < 0").groupBy("problem_id").agg(F.min(F.struct("edge_id", "src", "dst")).alias("e")).select("problem_id", "e.src", "e.dst", "e.edge_id")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, node_id, component: the least node that edges, in either direction, connect."""
    both = written(edges.select("problem_id", F.explode(F.array(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")), F.struct(F.col("dst").alias("x"), F.col("src").alias("y")))).alias("e")).select("problem_id", "e.x", "e.y").distinct(), "both")
    labels = written(nodes.select("problem_id", "node_id", F.col("node_id").alias("component")), "labels")
    while True:
        low = both.join(labels.select("problem_id", F.col("node_id").alias("y"), "component"), ["problem_id", "y"]).groupBy("problem_id", F.col("x").alias("node_id")).agg(F.min("component").alias("low"))
        new = written(labels.join(low, ["problem_id", "node_id"], "left").select("problem_id", "node_id", "component", F.least("component", "low").alias("next")), "labels")
        jump = new.select("problem_id", F.col("node_id").alias("next"), F.col("next").alias("beyond"))
        # A large component soon has one label, and its rows would meet in one task: labels of over HOT rows are few, so they are broadcast.
        hot = written(new.groupBy("problem_id", "next").count().where(F.col("count") > HOT).drop("count").join(jump, ["problem_id", "next"]), "hot-labels")
        cold = new.join(F.broadcast(hot.drop("beyond")), ["problem_id", "next"], "left_anti").join(jump, ["problem_id", "next"], "left")
        new = new.join(F.broadcast(hot), ["problem_id", "next"]).unionByName(cold)
        new = new.select("problem_id", "node_id", F.least("next", "beyond").alias("component"), (F.col("component") != F.least("next", "beyond")).alias("changed"))
        new = written(new, "labels")
        labels = new.select("problem_id", "node_id", "component")
        if not new.where("changed").take(1):
            return labels


def spanning_forest(nodes: DataFrame, edges: DataFrame, length: str = "length") -> DataFrame:
    """Edges of the minimum spanning forest, ties by edge_id (Boruvka: each component takes its least leaving edge a round).

    A component points to the one behind its edge; of two that chose one edge the lesser is the root, and pointers jump to the roots.
    Then edges move to the roots, and of those between two roots only the least stays, so every round's tables are smaller than the last's."""
    row = F.struct(F.col(length).alias(length), "edge_id", "src", "dst").alias("e")
    now, chosen = written(edges.where("src <> dst").select("problem_id", F.col("src").alias("u"), F.col("dst").alias("v"), row), "between"), []
    while True:
        side = lambda c, d: F.struct(F.col(c).alias("component"), F.col(d).alias("to"))
        ends = now.select("problem_id", "e", F.explode(F.array(side("u", "v"), side("v", "u"))).alias("s")).select("problem_id", "s.component", F.struct("e", F.col("s.to").alias("to")).alias("b"))
        best = written(ends.groupBy("problem_id", "component").agg(F.min("b").alias("b")).select("problem_id", "component", "b.e", "b.to"), "best")
        chosen.append(best.select("problem_id", "e.*").distinct())
        if not best.take(1):
            deleted(now)
            return reduce(DataFrame.unionByName, chosen)
        back = best.select("problem_id", F.col("component").alias("to"), F.col("to").alias("_back"))
        at = best.join(back, ["problem_id", "to"]).select("problem_id", "component", F.when((F.col("_back") == F.col("component")) & (F.col("component") < F.col("to")), F.col("component")).otherwise(F.col("to")).alias("root"))
        at = written(at, "roots")
        while True:
            beyond = at.select("problem_id", F.col("component").alias("root"), F.col("root").alias("_root"))
            then = written(at.join(beyond, ["problem_id", "root"]).select("problem_id", "component", F.col("_root").alias("root"), (F.col("_root") != F.col("root")).alias("moved")), "roots")
            deleted(at)
            at = then.drop("moved")
            at._netloom_path = then._netloom_path
            if not then.where("moved").take(1):
                break
        to = lambda c: at.select("problem_id", F.col("component").alias(c), F.col("root").alias(f"_{c}"))  # noqa: B023, E731
        moved = now.join(to("u"), ["problem_id", "u"]).join(to("v"), ["problem_id", "v"]).where("_u <> _v")
        then = written(moved.groupBy("problem_id", F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).agg(F.min("e").alias("e")), "between")
        deleted(now, at)
        now = then


def rooted(nodes: DataFrame, tree: DataFrame, length: str = "length") -> DataFrame:
    """problem_id, node_id, parent, parent_edge, depth, prefix_length, root, path: each component rooted at its least node."""
    roots = connected(nodes, tree).where("node_id = component")
    arcs = undirected(tree).join(tree.select("problem_id", "edge_id", length), ["problem_id", "edge_id"])
    arcs = arcs.select("problem_id", F.col("src").alias("node_id"), F.col("dst").alias("to"), "edge_id", F.col(length).cast("double").alias("w"), "direction")
    step = "array<struct<edge_id: bigint, direction: int>>"
    front = roots.select("problem_id", "node_id", F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("parent_edge"), F.lit(0).alias("depth"), F.lit(0.0).alias("prefix_length"), F.col("node_id").alias("root"), F.array().cast(step).alias("path"))
    front = written(front, "tree")
    out = front
    while True:
        front = front.join(arcs, ["problem_id", "node_id"]).where("NOT parent_edge <=> edge_id")
        front = front.select("problem_id", F.col("to").alias("node_id"), F.col("node_id").alias("parent"), F.col("edge_id").alias("parent_edge"), (F.col("depth") + 1).alias("depth"), (F.col("prefix_length") + F.col("w")).alias("prefix_length"), "root", F.array_append("path", F.struct("edge_id", F.col("direction").cast("int").alias("direction")).cast("struct<edge_id: bigint, direction: int>")).alias("path"))
        front = written(front, "tree")
        if not front.take(1):
            return out
        out = out.unionByName(front)


def cycles(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, edge_id and steps of the cycle that each edge off the tree closes: the edge itself, then the tree's path from
    its head back to its tail. tree is the result of rooted()."""
    of = lambda c, n: tree.select("problem_id", F.col("node_id").alias(c), F.col("path").alias(n), F.col("root").alias(f"root_{n}"))
    off = edges.join(tree.where("parent_edge IS NOT NULL").select("problem_id", F.col("parent_edge").alias("edge_id")), ["problem_id", "edge_id"], "left_anti")
    both = off.join(of("src", "tail"), ["problem_id", "src"]).join(of("dst", "head"), ["problem_id", "dst"]).where("root_tail = root_head")
    up = F.expr("reverse(transform(array_except(head, tail), s -> named_struct('edge_id', s.edge_id, 'direction', -s.direction)))")
    own = F.array(F.struct(F.col("edge_id"), F.lit(1).alias("direction")))
    return both.select("problem_id", "edge_id", F.concat(own, up, F.expr("array_except(tail, head)")).alias("steps"))


def cycle_scores(cycles_: DataFrame, values: DataFrame) -> DataFrame:
    """problem_id, edge_id, gradient, length, ratio: sums of signed gradients and of absolute lengths along each cycle.
    values: problem_id, edge_id, gradient, length."""
    s = cycles_.select("problem_id", F.col("edge_id").alias("off"), F.explode("steps").alias("s")).select("problem_id", "off", "s.edge_id", "s.direction")
    out = s.join(values, ["problem_id", "edge_id"]).groupBy("problem_id", F.col("off").alias("edge_id")).agg(F.sum(F.col("direction") * F.col("gradient")).alias("gradient"), F.sum(F.abs("length")).alias("length"))
    return out.withColumn("ratio", F.when(F.col("length") > 0, F.col("gradient") / F.col("length")))


def best_cycle(scores: DataFrame, digits: int = 12) -> DataFrame:
    """The least ratio of each problem; ratios equal to so many digits go by edge_id."""
    return scores.groupBy("problem_id").agg(F.min(F.struct(F.round("ratio", digits).alias("ratio"), "edge_id")).alias("b")).select("problem_id", "b.edge_id", "b.ratio")


def stretch(tree: DataFrame, edges: DataFrame, length: str = "length") -> DataFrame:
    """problem_id, edge_id, lca depth and stretch: the tree's distance between the ends over the edge's length (null if that isn't positive)."""
    of = lambda c, n: tree.select("problem_id", F.col("node_id").alias(c), F.col("path").alias(f"path_{n}"), F.col("prefix_length").alias(f"far_{n}"), F.col("root").alias(f"root_{n}"))
    both = edges.join(of("src", "u"), ["problem_id", "src"]).join(of("dst", "v"), ["problem_id", "dst"]).where("root_u = root_v")
    common = both.withColumn("shared", F.array_intersect("path_u", "path_v"))
    last = F.when(F.size("shared") > 0, F.element_at("shared", -1).edge_id)
    at = tree.select("problem_id", F.col("parent_edge").alias("last"), F.col("prefix_length").alias("far_lca"))
    out = common.withColumn("last", last).join(at, ["problem_id", "last"], "left")
    path = F.col("far_u") + F.col("far_v") - 2 * F.coalesce("far_lca", F.lit(0.0))
    return out.select("problem_id", "edge_id", F.size("shared").alias("lca_depth"), path.alias("path_length"), F.when(F.col(length) > 0, path / F.col(length)).alias("stretch"))


def spanner(stretches: DataFrame, bound: float) -> DataFrame:
    """Edges that the tree alone would lengthen beyond the bound: with the tree they make the spanner."""
    return stretches.where(F.col("stretch") > bound).select("problem_id", "edge_id")


def sparsify(edges: DataFrame, per_node: int = 2) -> DataFrame:
    """The first edges, by id, of each node."""
    ends = edges.select("problem_id", "edge_id", F.explode(F.array("src", "dst")).alias("node_id"))
    first = ends.withColumn("k", F.row_number().over(Window.partitionBy("problem_id", "node_id").orderBy("edge_id"))).where(F.col("k") <= per_node)
    return first.select("problem_id", "edge_id").distinct()


def sample_every(edges: DataFrame, stride: int) -> DataFrame:
    """Every stride-th edge by id: the sampling that approximate cycle searches and core sparsifiers use."""
    return edges.where(F.pmod("edge_id", F.lit(stride)) == 0)


def dirty_edges(before: DataFrame, after: DataFrame, gradient_change: float = 0.5, length_factor: float = 1.25) -> DataFrame:
    """problem_id, edge_id of edges whose gradient moved by more, or whose length by a larger factor, or that are new."""
    b = before.select("problem_id", "edge_id", F.col("gradient").alias("g0"), F.col("length").alias("l0"))
    j = after.join(b, ["problem_id", "edge_id"], "left")
    grown = F.greatest("length", "l0") > length_factor * F.least("length", "l0")
    return j.where(F.col("g0").isNull() | (F.abs(F.col("gradient") - F.col("g0")) > gradient_change) | grown).select("problem_id", "edge_id")


def clamp_length(length, n):
    """A length's size held within n^-4 and n^4."""
    n = n.cast("double")
    return F.least(F.greatest(F.abs(length), F.pow(n, F.lit(-4.0))), F.pow(n, F.lit(4.0)))


def low_degree(edges: DataFrame, gamma: float) -> DataFrame:
    """Nodes whose degree is below gamma * ln(n), rounded up."""
    d = degrees(edges)
    n = d.groupBy("problem_id").agg(F.ceil(gamma * F.ln(F.greatest(F.count("*"), F.lit(2)).cast("double"))).alias("least"))
    return d.join(n, "problem_id").where("degree < least").select("problem_id", "node_id", "degree")


def halved(nodes: DataFrame) -> DataFrame:
    """The map that contracts nodes 2v and 2v + 1 into v."""
    return nodes.select("problem_id", "node_id", F.floor(F.col("node_id") / 2).cast("bigint").alias("image"))


def parts(nodes: DataFrame, s: int) -> DataFrame:
    """Nodes dealt out by id modulo s."""
    return nodes.select("problem_id", "node_id", F.pmod("node_id", F.lit(s)).cast("int").alias("part"))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """One edge, of least id, for each unordered pair of different nodes."""
    pair = [F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")]
    return edges.where("src <> dst").groupBy("problem_id", *pair).agg(F.min("edge_id").alias("edge_id"))


def mean_stretch(stretches: DataFrame, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    s = stretches.where("stretch IS NOT NULL")
    return s.groupBy("problem_id").agg((F.sum(w * F.col("stretch")) / F.sum(w)).alias("mean_stretch"))


def reweighted(stretches: DataFrame, eta: float, weight: str = "weight") -> DataFrame:
    """Multiplicative weights: w * exp(-eta * stretch)."""
    return stretches.withColumn(weight, F.col(weight) * F.exp(-eta * F.coalesce("stretch", F.lit(0.0))))


def tree_weights(tree: DataFrame, edges: DataFrame, gamma: float, weight: str = "weight") -> DataFrame:
    """Weights of the tree's edges grow by gamma over the degrees of their ends."""
    d = degrees(edges)
    to = lambda c, n: d.select("problem_id", F.col("node_id").alias(c), F.col("degree").alias(n))
    e = edges.join(to("src", "du"), ["problem_id", "src"]).join(to("dst", "dv"), ["problem_id", "dst"]).join(tree.select("problem_id", "edge_id", F.lit(True).alias("chosen")), ["problem_id", "edge_id"], "left")
    return e.withColumn(weight, F.col(weight) + F.when(F.col("chosen"), gamma / F.col("du") + gamma / F.col("dv")).otherwise(0.0)).drop("du", "dv", "chosen")


def paths_valid(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, path_id, valid, length, gradient of paths (problem_id, path_id, k, edge_id, direction): whether each step exists
    and begins where the last ended."""
    e = steps.join(edges.select("problem_id", "edge_id", "src", "dst", "length", "gradient"), ["problem_id", "edge_id"], "left")
    ahead = F.col("direction") > 0
    e = e.withColumn("from", F.when(ahead, F.col("src")).otherwise(F.col("dst"))).withColumn("to", F.when(ahead, F.col("dst")).otherwise(F.col("src")))
    e = e.withColumn("last", F.lag("to").over(Window.partitionBy("problem_id", "path_id").orderBy("k")))
    ok = F.col("from").isNotNull() & (F.col("last").isNull() | (F.col("last") == F.col("from")))
    return e.groupBy("problem_id", "path_id").agg(F.every(ok).alias("valid"), F.sum("length").alias("length"), F.sum(F.col("direction") * F.col("gradient")).alias("gradient"))


def widths_stable(before: DataFrame, after: DataFrame, dirty: DataFrame, factor: float = 2.0) -> DataFrame:
    """problem_id, stable: no edge's width grew beyond the factor unless it is dirty."""
    j = after.join(before.select("problem_id", "edge_id", F.col("width").alias("was")), ["problem_id", "edge_id"]).join(dirty, ["problem_id", "edge_id"], "left_anti")
    ok = j.groupBy("problem_id").agg(F.every(F.col("width") <= factor * F.col("was")).alias("ok"))
    return after.select("problem_id").distinct().join(ok, "problem_id", "left").select("problem_id", F.coalesce("ok", F.lit(True)).alias("stable"))
