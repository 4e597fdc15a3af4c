"""Problems that reduce to flows, one grouped call for each problem."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.problem import Options
from ..plans.rewrite import unit_edges
from . import kernel
from .solve import solve


def convex_flow(nodes: DataFrame, edges: DataFrame, marginal_cost, digits: int = 0, max_units: int = 10_000, options: Options = Options()) -> DataFrame:
    """problem_id, edge_id, flow under convex costs: unit edges by marginal cost, solved as a linear problem, lower bounds added back."""
    from pyspark.sql import Window

    from ..plans.rewrite import remove_lower_bounds

    free, _ = remove_lower_bounds(nodes, edges)
    units = unit_edges(edges, marginal_cost, digits, max_units)
    falls = F.col("cost") < F.lag("cost").over(Window.partitionBy("problem_id", "edge_id").orderBy("unit"))
    units = units.withColumn("cost", F.when(falls, F.raise_error(F.lit("marginal costs fall")).cast("bigint")).otherwise(F.col("cost")))
    numbered = units.withColumn("own", F.col("edge_id")).withColumn("edge_id", F.row_number().over(Window.partitionBy("problem_id").orderBy("edge_id", "unit")).cast("bigint"))
    ready = numbered.select("problem_id", "edge_id", "own", "src", "dst", F.lit(0).cast("bigint").alias("lower"), F.lit(1).cast("bigint").alias("upper"), "cost")
    flows = solve(free, ready, options).flows.join(ready.select("problem_id", "edge_id", "own"), ["problem_id", "edge_id"]).groupBy("problem_id", "own").agg(F.sum("flow").alias("units"))
    out = edges.join(flows.withColumnRenamed("own", "edge_id"), ["problem_id", "edge_id"], "left")
    return out.select("problem_id", "edge_id", (F.col("lower") + F.coalesce("units", F.lit(0))).alias("flow"))


def _index(frame: pd.DataFrame, *columns: str) -> tuple[list, dict]:
    names = sorted(set().union(*(map(int, frame[c]) for c in columns)))
    return names, {v: i for i, v in enumerate(names)}


def max_flow(edges: DataFrame, terminals: DataFrame, capacity: str = "capacity", undirected: bool = False) -> DataFrame:
    """problem_id, kind, id, value: kind value (the maximum), edge (flow of edge id), side (nodes of the smallest minimum cut's source side).
    terminals: problem_id, source, sink."""

    def run(key, e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s, k in zip(t.source, t.sink, strict=True):
            e = e.sort_values("edge_id")
            names = sorted({*map(int, e.src), *map(int, e.dst), int(s), int(k)})
            place = {v: i for i, v in enumerate(names)}
            total, flow, side = kernel.max_flow(len(names), [place[x] for x in e.src], [place[x] for x in e.dst], e[capacity].tolist(), place[s], place[k], undirected)
            rows += [(key[0], "value", None, total)] + [(key[0], "edge", int(i), f) for i, f in zip(e.edge_id, flow, strict=True)] + [(key[0], "side", names[i], None) for i in sorted(side)]
        return pd.DataFrame(rows, columns=["problem_id", "kind", "id", "value"]).astype({"id": "Int64", "value": "Int64"})

    e = edges.select("problem_id", "edge_id", "src", "dst", capacity)
    return e.groupBy("problem_id").cogroup(terminals.groupBy("problem_id")).applyInPandas(run, "problem_id string, kind string, id bigint, value bigint")


def matching(pairs: DataFrame, weight: str = "weight") -> DataFrame:
    """problem_id, left, right: least weight among the matchings of most pairs; a missing weight is 0."""

    def run(e: pd.DataFrame) -> pd.DataFrame:
        found = kernel.matching(sorted(set(e.left)), sorted(set(e.right)), list(zip(e.left.tolist(), e.right.tolist(), e[weight].tolist(), strict=True)))
        return pd.DataFrame([(e.problem_id.iloc[0], int(u), int(v)) for u, v in found], columns=["problem_id", "left", "right"])

    e = pairs.select("problem_id", "left", "right", F.coalesce(F.col(weight), F.lit(0)).cast("bigint").alias(weight))
    return e.groupBy("problem_id").applyInPandas(run, "problem_id string, left bigint, right bigint")


def symmetric(found: DataFrame) -> DataFrame:
    """Both directions of a matching: problem_id, node, mate."""
    return found.select("problem_id", F.col("left").alias("node"), F.col("right").alias("mate")).unionByName(found.select("problem_id", F.col("right").alias("node"), F.col("left").alias("mate")))


def cut_facts(edges: DataFrame, capacity: str = "capacity") -> DataFrame:
    """problem_id, sparsest_ratio, sparsest_side, vertex_connectivity and tree (u, v, capacity of a Gomory-Hu tree) of undirected graphs."""

    def run(e: pd.DataFrame) -> pd.DataFrame:
        names, _ = _index(e, "src", "dst")
        es = list(zip(e.src.tolist(), e.dst.tolist(), e[capacity].tolist(), strict=True))
        ratio, side = kernel.sparsest_cut(names, es)
        tree = [{"u": u, "v": v, "capacity": c} for u, v, c in kernel.gomory_hu(names, es)]
        return pd.DataFrame([{"problem_id": e.problem_id.iloc[0], "sparsest_ratio": float(ratio), "sparsest_side": side, "vertex_connectivity": kernel.vertex_connectivity(names, es), "tree": tree}])

    ddl = "problem_id string, sparsest_ratio double, sparsest_side array<bigint>, vertex_connectivity bigint, tree array<struct<u: bigint, v: bigint, capacity: bigint>>"
    return edges.select("problem_id", "src", "dst", F.col(capacity).cast("bigint").alias(capacity)).groupBy("problem_id").applyInPandas(run, ddl)


def pairwise_cuts(facts: DataFrame) -> DataFrame:
    """problem_id, u, v, cut for all pairs of nodes, from the Gomory-Hu trees in cut_facts(): least capacity on the tree's path."""

    def run(e: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for pid, tree in zip(e.problem_id, e.tree, strict=True):
            seen: dict[int, dict[int, int]] = {}
            for t in tree:
                u, v, c = t["u"], t["v"], t["capacity"]
                a, b = {u: c, **{x: min(c, w) for x, w in seen.get(u, {}).items()}}, {v: c, **{x: min(c, w) for x, w in seen.get(v, {}).items()}}
                for x in a:
                    for y in b:
                        w = min(a[x], b[y])
                        seen.setdefault(x, {})[y] = w
                        seen.setdefault(y, {})[x] = w
            rows += [(pid, x, y, w) for x in seen for y, w in seen[x].items() if x < y]
        return pd.DataFrame(rows, columns=["problem_id", "u", "v", "cut"])

    return facts.select("problem_id", "tree").groupBy("problem_id").applyInPandas(run, "problem_id string, u bigint, v bigint, cut bigint")


def negative_cycles(edges: DataFrame, weight: str = "cost") -> DataFrame:
    """problem_id and the edges, in order, of one negative cycle of each problem that has any."""

    def run(e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("edge_id")
        names, place = _index(e, "src", "dst")
        found = kernel.negative_cycle(len(names), [(place[u], place[v], w) for u, v, w in zip(e.src, e.dst, e[weight], strict=True)])
        ids = e.edge_id.tolist()
        return pd.DataFrame([(e.problem_id.iloc[0], [ids[i] for i in found])] if found else [], columns=["problem_id", "cycle"])

    return edges.select("problem_id", "edge_id", "src", "dst", weight).groupBy("problem_id").applyInPandas(run, "problem_id string, cycle array<bigint>")


def isotonic_dag(values: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, node_id, fitted: weighted least squares that don't fall along edges. values: problem_id, node_id, value, weight."""

    def run(key, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("node_id")
        place = {int(x): i for i, x in enumerate(v.node_id)}
        fit = kernel.isotonic_dag(v.value.tolist(), v.weight.tolist(), [(place[a], place[b]) for a, b in zip(e.src, e.dst, strict=True)])
        return pd.DataFrame({"problem_id": key[0], "node_id": v.node_id, "fitted": fit})

    return values.groupBy("problem_id").cogroup(edges.select(*[F.col(c).alias(c) for c in ("problem_id", "src", "dst")]).groupBy("problem_id")).applyInPandas(run, "problem_id string, node_id bigint, fitted double")


def isotonic_chain(values: DataFrame) -> DataFrame:
    """The same on chains in the order of node_id, by pooling neighbours that violate the order; linear in the chain."""

    def run(v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("node_id")
        return pd.DataFrame({"problem_id": v.problem_id, "node_id": v.node_id, "fitted": kernel.isotonic_chain(v.value.tolist(), v.weight.tolist())})

    weight = F.col("weight") if "weight" in values.columns else F.lit(1.0)
    v = values.select("problem_id", "node_id", F.col("value").cast("double").alias("value"), weight.cast("double").alias("weight"))
    return v.groupBy("problem_id").applyInPandas(run, "problem_id string, node_id bigint, fitted double")


def isotonic_max(values: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, node_id, raised: each value raised to the largest that leads to it."""
    from ..plans.store import written

    known = written(values.select("problem_id", "node_id", F.col("value").alias("raised")), "raised")
    arcs = edges.select("problem_id", F.col("src").alias("node_id"), F.col("dst").alias("to"))
    while True:
        offers = arcs.join(known, ["problem_id", "node_id"]).groupBy("problem_id", F.col("to").alias("node_id")).agg(F.max("raised").alias("offer"))
        new = written(known.join(offers, ["problem_id", "node_id"], "left").select("problem_id", "node_id", F.greatest("raised", "offer").alias("raised"), F.coalesce(F.col("offer") > F.col("raised"), F.lit(False)).alias("changed")), "raised")
        known = new.select("problem_id", "node_id", "raised")
        if not new.where("changed").take(1):
            return known


def matrix_scaling(matrix: DataFrame, targets: DataFrame, rounds: int = 50) -> DataFrame:
    """problem_id, i, j, value of the scaled matrix; rows without a target get 1."""

    def run(key, m: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(m.i)), sorted(set(m.j))
        a = np.zeros((len(rows), len(cols)))
        a[[rows.index(x) for x in m.i], [cols.index(x) for x in m.j]] = m.value
        goal = dict(zip(t.i, t.target, strict=True))
        x, y = kernel.sinkhorn(a, np.array([goal.get(i, 1.0) for i in rows]), rounds)
        m = m.copy()
        m["value"] = [v * x[rows.index(i)] * y[cols.index(j)] for i, j, v in zip(m.i, m.j, m.value, strict=True)]
        return m[["problem_id", "i", "j", "value"]]

    return matrix.groupBy("problem_id").cogroup(targets.groupBy("problem_id")).applyInPandas(run, "problem_id string, i int, j int, value double")


