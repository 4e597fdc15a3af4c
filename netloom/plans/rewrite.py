"""Rewrites of problems, as plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remove_lower_bounds(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same problem with lower 0: capacities shrink, and what must flow moves into the demands."""
    moved = edges.select("problem_id", F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("lower").alias("d")), F.struct(F.col("dst").alias("node_id"), (-F.col("lower")).alias("d")))).alias("x"))
    moved = moved.groupBy("problem_id", "x.node_id").agg(F.sum("x.d").alias("moved"))
    out = nodes.join(moved, ["problem_id", "node_id"], "left").withColumn("demand", F.col("demand") + F.coalesce("moved", F.lit(0))).drop("moved")
    return out, edges.withColumn("upper", F.col("upper") - F.col("lower")).withColumn("lower", F.lit(0).cast("bigint"))


def saturate_negative(edges: DataFrame) -> DataFrame:
    """Starting flow: edges of negative cost are full, others at their lower bound."""
    return edges.withColumn("flow", F.when(F.col("cost") < 0, F.col("upper")).otherwise(F.col("lower")))


def split_vertices(nodes: DataFrame, edges: DataFrame, capacity: str = "capacity") -> tuple[DataFrame, DataFrame]:
    """Node v becomes 2v (which keeps the demand) and 2v + 1, joined by an edge of the node's capacity; ids of those edges are -1 - v."""
    zero = F.lit(0).cast("bigint")
    twice = nodes.select("problem_id", (2 * F.col("node_id")).alias("node_id"), "demand").unionByName(nodes.select("problem_id", (2 * F.col("node_id") + 1).alias("node_id"), zero.alias("demand")))
    inner = nodes.select("problem_id", (-1 - F.col("node_id")).alias("edge_id"), (2 * F.col("node_id")).alias("src"), (2 * F.col("node_id") + 1).alias("dst"), zero.alias("lower"), F.col(capacity).cast("bigint").alias("upper"), zero.alias("cost"))
    outer = edges.select("problem_id", "edge_id", (2 * F.col("src") + 1).alias("src"), (2 * F.col("dst")).alias("dst"), "lower", "upper", "cost")
    return twice, inner.unionByName(outer)


#: Edges with a bound beyond this stay alone, so that the bounds of 2^32 parallel edges still add up within 64 bits.
MOST_MERGED = 1 << 31
_CLASS = ["problem_id", "src", "dst", "cost", "alone", "own"]


def _of_class(edges: DataFrame) -> DataFrame:
    """edges with alone and own: edges of one problem that agree in src, dst, cost and these two can be merged. An edge that isn't right stays alone."""
    fits = F.expr(f"src IS NOT NULL AND dst IS NOT NULL AND cost IS NOT NULL AND coalesce(lower <= upper AND lower > -{MOST_MERGED} AND upper < {MOST_MERGED}, false)")
    return edges.withColumns({"alone": ~fits, "own": F.when(fits, F.lit(0).cast("bigint")).otherwise(F.col("edge_id"))})


def parallel_classes(edges: DataFrame, *sums: str) -> DataFrame:
    """Parallel edges of equal cost as one, named by the least of them, with alone and own; bounds and the columns sums add up. What one problem
    has to hold then grows with its distinct costs between two nodes, not with its edges. An edge_id that comes twice still does."""
    named = _of_class(edges.select("problem_id", "edge_id", "src", "dst", "lower", "upper", "cost", *sums))
    out = named.groupBy(*_CLASS).agg(F.min("edge_id").alias("edge_id"), *[F.sum(c).alias(c) for c in ("lower", "upper", *sums)])
    twice = edges.groupBy("problem_id", "edge_id").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("src", "dst", "lower", "upper", "cost", *sums)]).where("_n > 1")
    twice = twice.withColumns({"alone": F.lit(True), "own": F.col("edge_id"), "_n": F.explode(F.array(F.lit(1), F.lit(2)))})
    return out.unionByName(twice.select(*out.columns))


def of_members(edges: DataFrame, classes: DataFrame, flows: DataFrame, flow: str = "flow") -> DataFrame:
    """problem_id, edge_id, flow of every edge, from flows (problem_id, edge_id, flow) of its parallel_classes(): of each class, edges fill in the order of
    their ids."""
    found = classes.join(flows.select("problem_id", "edge_id", F.col(flow).alias("_flow")), ["problem_id", "edge_id"]).select(*_CLASS, (F.col("_flow") - F.col("lower")).alias("_over"))
    room = F.col("upper") - F.col("lower")
    before = F.sum(room).over(Window.partitionBy(*_CLASS).orderBy("edge_id").rowsBetween(Window.unboundedPreceding, -1))
    members = _of_class(edges.select("problem_id", "edge_id", "src", "dst", "lower", "upper", "cost")).withColumn("_before", F.coalesce(before, F.lit(0)))
    share = F.greatest(F.least(F.col("_over") - F.col("_before"), room), F.lit(0))
    return members.join(found, _CLASS).select("problem_id", "edge_id", (F.col("lower") + share).alias(flow))


def marginal(objective: str, k: Column, weight: Column, p: float = 2.0, scale: float = 1.0) -> Column:
    """Cost of the k-th unit: value at k less value at k - 1."""
    at = {
        "p_norm": lambda x: F.pow(x, F.lit(float(p))),
        "entropy": lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0),
        "matrix_scaling": lambda x: F.when(x > 0, x * F.ln(x) - x).otherwise(0.0),
    }[objective]
    k = k.cast("double")
    return F.lit(float(scale)) * weight * (at(k) - at(k - 1))


def unit_edges(edges: DataFrame, marginal_cost: Column, digits: int = 0, max_units: int = 10_000) -> DataFrame:
    """Convex costs as parallel unit edges: one for each unit of upper - lower, with columns unit and cost.

    marginal_cost is an expression over the edge's columns and unit (1, 2, ...); costs are scaled by 10**digits and rounded.
    A marginal that falls, or an edge with too many units, raises an error."""
    room = F.col("upper") - F.col("lower")
    units = edges.where(room > 0).withColumn("unit", F.explode(F.sequence(F.lit(1).cast("bigint"), F.when(room <= max_units, room).otherwise(F.raise_error(F.lit("too many units")).cast("bigint")))))
    return units.withColumn("cost", F.round(marginal_cost * F.lit(10.0**digits)).cast("bigint"))


def gcd_scale(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, capacity_gcd, cost_gcd: common divisors of bounds and demands, and of costs (1 where all are 0)."""
    euclid = """aggregate({0}, 0L, (a, x) -> aggregate(sequence(1, 64), named_struct('a', a, 'b', abs(x)),
        (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a))"""
    amounts = edges.select("problem_id", F.explode(F.array("lower", "upper")).alias("x")).unionByName(nodes.select("problem_id", F.col("demand").alias("x")))
    one = lambda c, n: F.greatest(F.expr(euclid.format(c)), F.lit(1)).alias(n)
    # A gcd of gcds: values are cut into parts first, so that no set holds all of a problem's values.
    part = lambda df, c: df.groupBy("problem_id", F.pmod(F.xxhash64(c), F.lit(1024)).alias("part")).agg(F.collect_set(F.abs(c)).alias("v")).select("problem_id", F.expr(euclid.format("v")).alias("g"))
    caps = part(amounts, "x").groupBy("problem_id").agg(F.collect_set("g").alias("v")).select("problem_id", one("v", "capacity_gcd"))
    costs = part(edges.withColumn("x", F.col("cost")), "x").groupBy("problem_id").agg(F.collect_set("g").alias("v")).select("problem_id", one("v", "cost_gcd"))
    return caps.join(costs, "problem_id")


def size_facts(edges: DataFrame) -> DataFrame:
    """Per problem: m, largest bound and cost, common power of two of bounds, cost bounds, whether scaling would be chosen."""
    low_bit = lambda c: F.when(F.col(c) != 0, F.col(c).bitwiseAND(-F.col(c)))
    d = lambda c: F.col(c).cast("decimal(19,0)")
    facts = edges.groupBy("problem_id").agg(
        F.count("*").alias("m"),
        F.max(F.greatest(F.abs("lower"), F.abs("upper"))).alias("max_bound"),
        F.max(F.abs("cost")).alias("max_cost"),
        F.least(F.min(low_bit("lower")), F.min(low_bit("upper"))).alias("power_of_two"),
        F.sum(F.when(F.col("cost") >= 0, d("cost") * d("lower")).otherwise(d("cost") * d("upper"))).alias("cost_lower_bound"),
        F.sum(F.abs(d("cost"))).alias("abs_cost"),
    )
    cube = F.col("m").cast("decimal(19,0)") * F.col("m") * F.col("m")
    return facts.withColumn("cost_upper_bound", F.col("abs_cost") * F.col("max_bound")).withColumn("needs_scaling", F.greatest("max_bound", "max_cost") > cube).drop("abs_cost")


def polynomial_costs(edges: DataFrame) -> DataFrame:
    """edges with scaled_cost, the cost over the largest power of two that the problem's largest cost holds, and its exponent."""
    top = edges.groupBy("problem_id").agg(F.floor(F.log2(F.greatest(F.max(F.abs("cost")), F.lit(1)).cast("double"))).cast("int").alias("exponent"))
    return edges.join(top, "problem_id").withColumn("scaled_cost", F.round(F.col("cost") / F.pow(F.lit(2.0), "exponent")).cast("bigint"))


def polynomial_capacities(edges: DataFrame) -> DataFrame:
    """The same of upper, as scaled_upper of at least 1."""
    top = edges.groupBy("problem_id").agg(F.floor(F.log2(F.greatest(F.max("upper"), F.lit(1)).cast("double"))).cast("int").alias("exponent"))
    return edges.join(top, "problem_id").withColumn("scaled_upper", F.greatest(F.round(F.col("upper") / F.pow(F.lit(2.0), "exponent")), F.lit(1)).cast("bigint"))


def unscaled(flow: Column, *exponents: Column) -> Column:
    for e in exponents:
        flow = flow * F.pow(F.lit(2.0), e)
    return flow


def rounding_instance(nodes: DataFrame, edges: DataFrame, flows: DataFrame, epsilon: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """What is left to round of a fractional flow: floors are fixed (whole values within epsilon too), edges with a fraction are
    unit edges from base on, and demands are what the floors lack."""
    f = edges.join(flows, ["problem_id", "edge_id"])
    near = F.abs(F.col("flow") - F.round("flow")) <= epsilon
    base = f.withColumn("base", F.when(near, F.round("flow")).otherwise(F.floor("flow")).cast("bigint")).withColumn("fraction", ~near)
    zero = F.lit(0).cast("bigint")
    left = base.where("fraction").select("problem_id", "edge_id", "src", "dst", zero.alias("lower"), F.lit(1).cast("bigint").alias("upper"), "cost", "base")
    ends = base.select("problem_id", F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("base").alias("d")), F.struct(F.col("dst").alias("node_id"), (-F.col("base")).alias("d")))).alias("x"))
    moved = ends.groupBy("problem_id", "x.node_id").agg(F.sum("x.d").alias("moved"))
    needs = nodes.join(moved, ["problem_id", "node_id"], "left").select("problem_id", "node_id", (F.col("demand") + F.coalesce("moved", zero)).alias("demand"))
    return needs, left


def near_integer(flows: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    return flows.groupBy("problem_id").agg(F.every(F.abs(F.col("flow") - F.round("flow")) <= epsilon).alias("near_integer"))


def clamped_flow(edges: DataFrame, epsilon: float) -> DataFrame:
    """edges whose flow is kept epsilon within its bounds, and whether that moved it."""
    to = F.greatest(F.least(F.col("flow").cast("double"), F.col("upper") - epsilon), F.col("lower") + epsilon)
    return edges.withColumn("moved", to != F.col("flow")).withColumn("flow", to)


def midpoints(edges: DataFrame) -> DataFrame:
    return edges.withColumn("flow", (F.col("lower") + F.col("upper")) / 2)
