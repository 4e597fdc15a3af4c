"""Guarded arithmetic, barriers and the aggregates of interior-point methods, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LOG = 50.0


@dataclass(frozen=True)
class Clamps:
    most_log: float = 50.0
    least_residual: float = 1e-12
    least_alpha: float = 1e-6
    most_alpha: float = 0.999
    most_barrier: float = 1e100
    most_gradient: float = 1e100


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def clamp_log(x: Column) -> Column:
    return clamped(x, -MOST_LOG, MOST_LOG)


def guarded_pow(base: Column, exponent: float | Column, most_log: float = MOST_LOG) -> Column:
    """0 at and below 0; the exponent of the logarithm is held within bounds, beyond which the result is 0 or infinite."""
    e = F.lit(float(exponent)) if not isinstance(exponent, Column) else exponent
    log = e * clamp_log(F.ln(base))
    return F.when(base <= 0, 0.0).when(log > most_log, F.lit(float("inf"))).when(log < -most_log, 0.0).otherwise(F.exp(log))


def guarded_log(x: Column, least: float) -> Column:
    return F.when(x <= 0, F.lit(float("-inf"))).otherwise(clamp_log(F.ln(F.greatest(x, F.lit(least)))))


def guarded_inverse(x: Column, least: float) -> Column:
    return F.when(F.abs(x) < least, F.when(x < 0, -1.0 / least).otherwise(1.0 / least)).otherwise(F.lit(1.0) / x)


def safe_log(x: Column, least: float) -> Column:
    return F.ln(F.greatest(x, F.lit(least)))


def safe_exp(x: Column, most: float) -> Column:
    return F.exp(F.least(x, F.lit(most)))


def barrier_power(x: Column, alpha: float) -> Column:
    return F.pow(x, F.lit(float(alpha)))


def barrier_inverse_power(x: Column, alpha: float) -> Column:
    return F.pow(x, F.lit(-float(alpha)))


def barrier_term(residual: Column, alpha: float, clamps: Clamps = Clamps()) -> Column:
    value = guarded_pow(F.greatest(residual, F.lit(clamps.least_residual)), -alpha, clamps.most_log)
    return F.when(residual <= 0, clamps.most_barrier).otherwise(F.least(value, F.lit(clamps.most_barrier)))


def gradient_term(residual: Column, alpha: float, clamps: Clamps = Clamps()) -> Column:
    value = F.lit(alpha) * guarded_pow(F.greatest(residual, F.lit(clamps.least_residual)), -alpha - 1, clamps.most_log)
    return F.when(residual <= 0, clamps.most_gradient).otherwise(F.least(value, F.lit(clamps.most_gradient)))


def barrier_lengths(flow: Column, lower: Column, upper: Column, beta: float, least: float) -> Column:
    return barrier_inverse_power(F.greatest(upper - flow, F.lit(least)), beta) + barrier_inverse_power(F.greatest(flow - lower, F.lit(least)), beta)


def barrier_gradient(flow: Column, lower: Column, upper: Column, beta: float, least: float) -> Column:
    up, down = F.greatest(upper - flow, F.lit(least)), F.greatest(flow - lower, F.lit(least))
    return F.lit(beta) * (barrier_inverse_power(up, beta + 1) - barrier_inverse_power(down, beta + 1))


def gradient_proxy(cost: Column, flow: Column, lower: Column, upper: Column, mu: float, epsilon: float) -> Column:
    up, down = F.greatest(upper - flow, F.lit(epsilon)), F.greatest(flow - lower, F.lit(epsilon))
    return cost + F.lit(mu) * (F.lit(1.0) / up - F.lit(1.0) / down)


def gap_proxy(gradient: Column, flow: Column) -> Column:
    """To be summed."""
    return F.abs(gradient) * (F.abs(flow) + 1e-12)


def lengths(gradient: Column) -> Column:
    return F.lit(1.0) / F.greatest(F.abs(gradient), F.lit(1e-12))


def edge_gradient(cost: Column, up: Column, down: Column, gap: Column, alpha: float, beta: float, clamps: Clamps = Clamps()) -> Column:
    """Of the potential: cost, cost over the gap, and the barrier's derivative at the slacks up and down."""
    bound = lambda x: clamped(x, -clamps.most_gradient, clamps.most_gradient)
    return cost + cost / (F.lit(alpha) * gap) + bound(F.lit(beta) * (guarded_pow(up, beta - 1) - guarded_pow(down, beta - 1)))


def potential(df: DataFrame, alpha: float, beta: float, lower_bound: float, least_gap: float = 1e-9) -> DataFrame:
    """problem_id, cost, barrier, potential, gap of a table with flow, cost, lower, upper."""
    up, down = F.greatest(F.col("upper") - F.col("flow"), F.lit(1e-12)), F.greatest(F.col("flow") - F.col("lower"), F.lit(1e-12))
    barrier = guarded_pow(up, beta) + guarded_pow(down, beta)
    sums = df.groupBy("problem_id").agg(F.sum(F.col("flow") * F.col("cost")).alias("total"), F.sum(barrier).alias("barrier"))
    gap = F.greatest(F.col("total") - lower_bound, F.lit(least_gap))
    return sums.select(
        "problem_id", "total", "barrier", (F.col("total") + F.ln(gap) / alpha + F.col("barrier")).alias("potential"), (F.greatest(F.col("total") - lower_bound, F.lit(0.0)) + F.col("barrier") / beta).alias("gap")
    )


def gap_threshold(m: Column, most: Column, exponent: float = 10.0) -> Column:
    return F.pow(m * F.greatest(most, F.lit(1)), F.lit(-float(exponent)))


def taylor_step(df: DataFrame, most: float) -> DataFrame:
    """problem_id, step: -sum(gradient delta) / sum(length delta^2), within 0..most."""
    g, d, w = F.col("gradient"), F.col("delta"), F.col("length")
    return df.groupBy("problem_id").agg(clamped(-F.sum(g * d) / F.greatest(F.sum(w * d * d), F.lit(1e-12)), 0.0, most).alias("step"))


def longest_step(df: DataFrame) -> DataFrame:
    """problem_id, step: the ratio test, how far flow can move along delta within its bounds."""
    d = F.col("delta")
    room = F.when(d > 0, (F.col("upper") - F.col("flow")) / d).when(d < 0, (F.col("flow") - F.col("lower")) / -d)
    return df.groupBy("problem_id").agg(F.min(room).alias("step"))


def stable(df: DataFrame, a: str, b: str, most: float = 1e6) -> DataFrame:
    ok = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & (F.abs(F.col(a) - F.col(b)) <= most)
    return df.groupBy("problem_id").agg(F.every(ok).alias("stable"))


def norms(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return df.groupBy("problem_id").agg(F.sum(x * y).alias("dot"), F.sum(F.abs(x)).alias("l1"), F.sqrt(F.sum(x * x)).alias("l2"))


def scaled_add(target: Column, scale: float, values: Column) -> Column:
    return target + F.lit(scale) * values


def decayed_sum(history: Column, ratio: float = 0.5) -> Column:
    """Of an array, newest last: the sum of ratio^k times the k-th from the end, the newest counting whole."""
    return F.aggregate(history, F.lit(0.0), lambda a, x: a * ratio + x)
