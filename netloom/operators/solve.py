"""Minimum-cost flow over tables of problems: one shuffle by problem_id brings a problem's nodes and edges together."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import rewrite
from ..plans.problem import Options
from ..plans.store import written
from . import kernel

NODE_COLUMNS = ["problem_id", "node_id", "demand"]
EDGE_COLUMNS = ["problem_id", "edge_id", "src", "dst", "lower", "upper", "cost"]
_ROWS = "problem_id string, kind string, id bigint, value bigint, cost string, status string, message string"


def _check(nodes: pd.DataFrame, edges: pd.DataFrame) -> str | None:
    """What makes one problem invalid."""
    known = set(nodes.node_id)
    if nodes[["node_id", "demand"]].isna().to_numpy().any() or edges[["src", "dst", "lower", "upper", "cost"]].isna().to_numpy().any():
        return "a value is missing"
    if len(known) < len(nodes) or edges.edge_id.duplicated().any():
        return "duplicate node or edge"
    if not known.issuperset(edges.src) or not known.issuperset(edges.dst):
        return "endpoint without node"
    if sum(map(int, nodes.demand)):
        return "demands do not sum to zero"
    if (edges.lower > edges.upper).any():
        return "lower above upper"
    return None


def _solver(options: Options):
    def run(key, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes, edges = nodes.sort_values("node_id"), edges.sort_values("edge_id")
        rows, status, message, cost = [], "OPTIMAL", None, None
        if bad := _check(nodes, edges):
            status, message = "INVALID", bad
        else:
            ids = [int(x) for x in nodes.node_id]
            place = {v: i for i, v in enumerate(ids)}
            ints = lambda c: [int(x) for x in edges[c]]
            deadline = time.monotonic() + options.time_limit_s if options.time_limit_s else None
            try:
                flow, pi = kernel.min_cost_flow(
                    len(ids), [place[x] for x in ints("src")], [place[x] for x in ints("dst")], ints("lower"), ints("upper"), ints("cost"), [int(d) for d in nodes.demand], options.max_augmentations, deadline
                )
                cost = str(sum(f * c for f, c in zip(flow, ints("cost"), strict=True)))
                rows = [(key[0], "edge", e, f, None, None, None) for e, f in zip(ints("edge_id"), flow, strict=True)]
                rows += [(key[0], "node", v, p, None, None, None) for v, p in zip(ids, pi, strict=True)]
            except kernel.Infeasible:
                status, message = "INFEASIBLE", "no flow meets all demands and bounds"
            except kernel.Limit:
                status, message = "LIMIT", "the time or augmentation limit was reached"
        if options.raise_on_error and status != "OPTIMAL":
            raise ValueError(f"problem {key[0]}: {status}: {message}")
        rows.append((key[0], "problem", None, None, cost, status, message))
        out = pd.DataFrame(rows, columns=["problem_id", "kind", "id", "value", "cost", "status", "message"])
        return out.astype({"id": "Int64", "value": "Int64"})

    return run


class Solution:
    """flows: problem_id, edge_id, flow. potentials: problem_id, node_id, potential. solutions: problem_id, status, cost, solver_mode, message."""

    def __init__(self, rows: DataFrame, edges: DataFrame, classes: DataFrame):
        of_classes = rows.where("kind = 'edge'").select("problem_id", F.col("id").alias("edge_id"), F.col("value").alias("flow"))
        self.flows = written(rewrite.of_members(edges, classes, of_classes), "flows")
        self.potentials = rows.where("kind = 'node'").select("problem_id", F.col("id").alias("node_id"), F.col("value").alias("potential"))
        self.solutions = rows.where("kind = 'problem'").select("problem_id", "status", F.col("cost").cast("decimal(38,0)").alias("cost"), F.lit("classic").alias("solver_mode"), "message")


def by_problem(nodes: DataFrame, edges: DataFrame, run: Callable, rows: str) -> DataFrame:
    """run(key, nodes, edges) for each problem. Tables are small beside the work on them, so problems are dealt to a number of tasks that
    adaptive execution doesn't lower."""
    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    nodes, edges = (df.repartition(tasks, "problem_id") for df in (nodes, edges))
    return nodes.groupBy("problem_id").cogroup(edges.groupBy("problem_id")).applyInPandas(run, rows)


def solve(nodes: DataFrame, edges: DataFrame, options: Options = Options()) -> Solution:
    """Exact flows of all problems. The solve runs once; its rows are written in the shared folder. Parallel edges of equal cost are merged for it,
    so that a problem's worker holds one of them.

    A bad problem does not fail the others: its status is INVALID or INFEASIBLE. Problems without edges get a status too."""
    # Aliases, as both tables may derive from one.
    nodes, edges = (df.select(*[F.col(c).alias(c) for c in columns]) for df, columns in ((nodes, NODE_COLUMNS), (edges, EDGE_COLUMNS)))
    classes = written(rewrite.parallel_classes(edges), "classes")
    rows = written(by_problem(nodes, classes.select(*EDGE_COLUMNS), _solver(options), _ROWS), "solved")
    return Solution(rows, edges, classes)


def merge_parallel(edges: DataFrame) -> DataFrame:
    """Parallel edges of equal cost as one: bounds add up."""
    return edges.groupBy("problem_id", "src", "dst", "cost").agg(F.min("edge_id").alias("edge_id"), F.sum("lower").alias("lower"), F.sum("upper").alias("upper"))


def flow_cost(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """problem_id, cost: flow times cost, a missing flow is 0."""
    d = lambda c: F.col(c).cast("decimal(19,0)")
    joined = edges.join(flows, ["problem_id", "edge_id"], "left").withColumn("flow", F.coalesce("flow", F.lit(0).cast("bigint")))
    return joined.groupBy("problem_id").agg(F.sum(d("flow") * d("cost")).alias("cost"))


def nested_flows(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """problem_id, src, and a map from dst to flow; parallel edges add up."""
    by = edges.join(flows, ["problem_id", "edge_id"]).groupBy("problem_id", "src", "dst").agg(F.sum("flow").alias("flow"))
    return by.groupBy("problem_id", "src").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dst", "flow")))).alias("flows"))


def certify(nodes: DataFrame, edges: DataFrame, solution: Solution) -> DataFrame:
    """problem_id, bounds, balance, reduced_costs: how many edges break their bounds, nodes their demand, and residual arcs
    the optimality condition cost + potential(src) - potential(dst) >= 0. All 0: the flow is optimal."""
    f = edges.join(solution.flows, ["problem_id", "edge_id"], "left")
    p = solution.potentials
    f = f.join(p.select("problem_id", F.col("node_id").alias("src"), F.col("potential").alias("pu")), ["problem_id", "src"], "left")
    f = f.join(p.select("problem_id", F.col("node_id").alias("dst"), F.col("potential").alias("pv")), ["problem_id", "dst"], "left")
    reduced = F.col("cost") + F.col("pu") - F.col("pv")
    wrong = ((F.col("flow") < F.col("upper")) & (reduced < 0)) | ((F.col("flow") > F.col("lower")) & (reduced > 0))
    by_edge = f.groupBy("problem_id").agg(
        F.count_if(F.col("flow").isNull() | (F.col("flow") < F.col("lower")) | (F.col("flow") > F.col("upper"))).alias("bounds"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("reduced_costs")
    )
    net = f.select("problem_id", F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.col("flow").alias("d")), F.struct(F.col("src").alias("node_id"), (-F.col("flow")).alias("d")))).alias("x"))
    net = net.groupBy("problem_id", "x.node_id").agg(F.sum("x.d").alias("net"))
    by_node = nodes.join(net, ["problem_id", "node_id"], "left").groupBy("problem_id").agg(F.count_if(F.coalesce("net", F.lit(0)) != F.col("demand")).alias("balance"))
    return by_node.join(by_edge, "problem_id", "left").select("problem_id", F.coalesce("bounds", F.lit(0)).alias("bounds"), "balance", F.coalesce("reduced_costs", F.lit(0)).alias("reduced_costs"))
