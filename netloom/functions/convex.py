"""Convex costs and per-edge scores, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def p_norm(flow: Column, weight: Column, p: float) -> Column:
    return F.pow(F.abs(weight * flow), F.lit(float(p))) / max(p, 1.0)


def p_norm_grad(flow: Column, weight: Column, p: float) -> Column:
    return F.signum(weight * flow) * F.pow(F.abs(weight * flow), F.lit(p - 1.0)) * weight


def entropy(flow: Column, eta: float) -> Column:
    x = F.greatest(flow, F.lit(1e-12))
    return x * F.ln(x) - x + 1.0 / eta


def entropy_grad(flow: Column) -> Column:
    return F.ln(F.greatest(flow, F.lit(1e-12)))


def scores(edges: DataFrame, nodes: DataFrame, p: float = 2.0, eta: float = 0.1, weight: Column | None = None) -> DataFrame:
    """Per edge: p_norm_score, transport_score, diffusion_score. They rank edges; they don't conserve flow."""
    w = weight if weight is not None else F.lit(1.0)
    total = nodes.groupBy("problem_id").agg(F.sum(F.abs("demand")).cast("double").alias("total"), F.abs(F.sum("demand")).cast("double").alias("net"))
    count = edges.groupBy("problem_id").agg(F.count("*").alias("m"))
    # One row a problem on that side; Spark picks the join by its size.
    e = edges.join(total.join(count, "problem_id"), "problem_id")
    return e.select(
        "problem_id",
        "edge_id",
        F.pow((F.abs("cost") + F.col("total")) / w, F.lit(1.0 / p)).alias("p_norm_score"),
        (F.exp(-F.lit(eta) * F.col("cost")) / F.col("m") * F.col("total")).alias("transport_score"),
        (F.greatest("net", F.lit(1.0)) / F.greatest(F.abs("cost").cast("double"), F.lit(1e-9))).alias("diffusion_score"),
    )


def convex_total(edges: DataFrame, value: Column) -> DataFrame:
    """problem_id, total: linear cost and convex value of a table with flow and cost."""
    return edges.groupBy("problem_id").agg((F.sum(F.col("cost") * F.col("flow")) + F.sum(value)).alias("total"))
