"""What an interior-point run reports and decides by: clamp counters, thresholds, step rules and rebuild schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numerics import MOST_LOG, Clamps, barrier_term, clamp_log, gap_threshold, gradient_term, guarded_pow

#: Problems up to so many edges or nodes are solved without a descent.
SMALL_EDGES, SMALL_NODES = 12, 8


def pow_clamped(base: Column, exponent: float, most_log: float = MOST_LOG) -> Column:
    """Whether guarded_pow changed its result."""
    return (base <= 0) | (F.ln(base) != clamp_log(F.ln(base))) | (F.abs(F.lit(float(exponent)) * clamp_log(F.ln(base))) > most_log)


def log_clamped(x: Column, least: float) -> Column:
    return (x < least) | (F.ln(x) != clamp_log(F.ln(x)))


def inverse_clamped(x: Column, least: float) -> Column:
    return F.abs(x) < least


def alpha_clamped(alpha: Column, clamps: Clamps = Clamps()) -> Column:
    return (alpha < clamps.least_alpha) | (alpha > clamps.most_alpha)


def barrier_clamped(residual: Column, alpha: float, clamps: Clamps = Clamps()) -> Column:
    return (residual < clamps.least_residual) | (barrier_term(residual, alpha, clamps) >= clamps.most_barrier)


def gradient_clamped(residual: Column, alpha: float, clamps: Clamps = Clamps()) -> Column:
    return (residual < clamps.least_residual) | (gradient_term(residual, alpha, clamps) >= clamps.most_gradient)


def residuals(edges: DataFrame, least: float = 1e-12) -> DataFrame:
    """edges with the slacks up and down, held at least so large, and whether that changed them."""
    up, down = (F.col("upper") - F.col("flow")).cast("double"), (F.col("flow") - F.col("lower")).cast("double")
    out = edges.withColumn("up_clamped", up < least).withColumn("down_clamped", down < least)
    return out.withColumn("up", F.greatest(up, F.lit(least))).withColumn("down", F.greatest(down, F.lit(least)))


def clamp_stats(df: DataFrame, flags: dict[str, Column], residual: Column, barrier: Column) -> DataFrame:
    """Per problem: a counter for each flag, the least residual, the largest finite barrier, all clamps and whether there were any."""
    finite = F.when(~F.isnan(barrier) & (F.abs(barrier) < float("inf")), barrier)
    out = df.groupBy("problem_id").agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()], F.min(residual).alias("least_residual"), F.max(finite).alias("most_barrier"))
    total = sum((F.col(name) for name in flags), F.lit(0).cast("bigint"))
    return out.withColumn("clamps", total).withColumn("clamped", total > 0)


def merged_stats(*stats: DataFrame) -> DataFrame:
    """The stats of all parts together: counters add up, extremes are those of all."""
    every = stats[0]
    for other in stats[1:]:
        every = every.unionByName(other)
    how = {"least_residual": F.min, "most_barrier": F.max, "clamped": F.max}
    return every.groupBy("problem_id").agg(*[how.get(c, F.sum)(c).alias(c) for c in every.columns if c != "problem_id"])


def classic_chosen(m: Column, n: Column, use_ipm: bool | None = None, most_iterations: int = 1) -> Column:
    if use_ipm is False or most_iterations == 0:
        return F.lit(True)
    return F.lit(False) if use_ipm else (m <= SMALL_EDGES) | (n <= SMALL_NODES)


def iterations_for(m: Column, factor: float) -> Column:
    """sqrt(m) max(ln(m / factor), 1), rounded up."""
    mm, eps = F.greatest(m, F.lit(1)).cast("double"), max(abs(factor), 1e-12)
    return F.ceil(F.sqrt(mm) * F.greatest(F.ln(mm / eps), F.lit(1.0)))


def almost_linear(m: Column, iterations: Column, factor: float) -> Column:
    return iterations <= iterations_for(m, factor)


def falls_back(termination: Column, iterations: Column, most: Column) -> Column:
    return (termination == "ITERATION_LIMIT") & (iterations > 2 * most)


def termination_target(m: Column, most: Column) -> Column:
    """most: the largest bound; the target is -200 m max(ln(m most), 1)."""
    return F.lit(-200.0) * m * F.greatest(F.ln(m * most), F.lit(1.0))


def reduction_floor(potential: Column, m: Column, most: Column) -> Column:
    """The least drop of the potential that a step must bring."""
    log = F.greatest(F.ln(m * most), F.lit(2.0))
    return F.least(F.greatest(F.abs(potential), F.lit(1.0)) / F.greatest(log * log * log * m, F.lit(1.0)), F.lit(1e-6))


def kappa_floor(m: Column) -> Column:
    return F.lit(1.0) / F.greatest(F.ln(m), F.lit(2.0))


def terminates(gap: Column, m: Column, most: Column, exponent: float = 10.0) -> Column:
    return gap <= gap_threshold(m, most, exponent)


def gap_estimates(edges: DataFrame, alpha: float, clamps: Clamps = Clamps()) -> DataFrame:
    """problem_id, estimate: scale exp(-phi / 20m), where phi weighs the barrier sum of all slacks; infinite where not finite."""
    slack = residuals(edges, clamps.least_residual)
    sums = slack.groupBy("problem_id").agg(
        F.count("*").alias("m"), F.max("upper").alias("most"), F.sum(F.col("flow") * F.col("cost")).cast("double").alias("total"), F.sum(barrier_term(F.col("up"), alpha, clamps) + barrier_term(F.col("down"), alpha, clamps)).alias("barrier")
    )
    scale = F.greatest(F.abs("total"), F.lit(1.0), F.col("most").cast("double"))
    estimate = scale * F.exp(-(F.col("m") * F.ln(scale) + abs(alpha) * F.col("barrier")) / (20.0 * F.col("m")))
    return sums.select("problem_id", F.when(F.isnan(estimate), float("inf")).otherwise(F.greatest(estimate, F.lit(0.0))).alias("estimate"))


def spanner_parameters(n: Column, m: Column, factor: float | None = None) -> dict[str, Column]:
    """Levels, stretch, bounds and recourse of a spanner of a graph of n nodes and m edges."""
    n, m = F.greatest(n, F.lit(2)).cast("double"), F.greatest(m, F.lit(2)).cast("double")
    log_n = F.ln(n)
    depth = F.greatest(F.floor(F.pow(F.ln(m), F.lit(0.25))), F.lit(1))
    epsilon = F.lit(1.0) / F.greatest(log_n * log_n, F.lit(1.0)) if factor is None else F.lit(max(abs(factor), 1e-6))
    return {
        "depth": depth,
        "epsilon": epsilon,
        "levels": F.greatest(F.ceil(F.sqrt(log_n)), F.lit(1)),
        "stretch": F.greatest(log_n * log_n, F.lit(1.0)) * (1 + epsilon),
        "congestion": F.greatest(log_n, F.lit(1.0)),
        "recourse": F.pow(n, 1 / depth),
        "recourse_limit": F.ceil(F.pow(n, 1 / depth)),
    }


def rebuild_due(iteration: Column, accumulated: Column, every: int = 0, threshold: float | None = None) -> Column:
    """By period, by accumulated instability, or by either."""
    out = (iteration % every == 0) if every else F.lit(False)
    return out if threshold is None else out | (accumulated >= threshold)


def budget_rebuilds(updates: DataFrame, budget: float, order: str = "t") -> DataFrame:
    """updates (problem_id, t, amount): spent, the amounts so far, and how many whole budgets that is. A rebuild is due where one fills."""
    spent = F.sum(F.greatest(F.col("amount"), F.lit(0.0))).over(Window.partitionBy("problem_id").orderBy(order))
    out = updates.withColumn("spent", spent).withColumn("rebuilds", F.floor(F.col("spent") / max(budget, 1.0)))
    before = F.lag("rebuilds", 1, 0).over(Window.partitionBy("problem_id").orderBy(order))
    return out.withColumn("due", F.col("rebuilds") > before)


def amortized(df: DataFrame, updates: str, queries: str) -> DataFrame:
    u, q = F.sum(updates), F.sum(queries)
    return df.groupBy("problem_id").agg(F.when(q == 0, 0.0).otherwise(u / q).alias("updates_per_query"))


class Game:
    """A rebuilding game of levels 1..l over n nodes and m edges. Level j is played at multiples of n^(1 - j/l); a level is rebuilt when its
    losses since the last time exceed ln(n) / p_j, so at every (budget + 1)-th loss, which a window counts."""

    def __init__(self, n: int, m: int, levels: int):
        self.n, self.m, self.levels = max(2, n), max(1, m), max(1, levels)
        self.thresholds = [max(1, math.floor(self.n ** (1 - j / self.levels) + 0.5)) for j in range(1, self.levels + 1)]
        self.odds = [0.5 if j == 1 else 1 - 1 / j for j in range(1, self.levels + 1)]
        self.budgets = [math.ceil(max(1.0, math.log(self.n)) / p) for p in self.odds]

    def _of_level(self, values: list, level: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), level)

    def played(self, rounds: DataFrame) -> DataFrame:
        """rounds (problem_id, t, won) with level, losses (of that level so far) and rebuild."""
        level = F.lit(self.levels)
        for j in reversed(range(self.levels)):
            level = F.when(F.col("t") % self.thresholds[j] == 0, F.lit(j + 1)).otherwise(level)
        lost = F.sum((~F.col("won")).cast("bigint")).over(Window.partitionBy("problem_id", "level").orderBy("t"))
        out = rounds.withColumn("level", level).withColumn("losses", lost)
        return out.withColumn("rebuild", ~F.col("won") & (F.col("losses") % (self._of_level(self.budgets, F.col("level")) + 1) == 0))

    def stats(self, rounds: DataFrame) -> DataFrame:
        """Per level: rounds, win rate, rebuilds, and losses pending since the last rebuild."""
        by = self.played(rounds).groupBy("problem_id", "level").agg(F.count("*").alias("rounds"), F.avg(F.col("won").cast("double")).alias("win_rate"), F.count_if("rebuild").alias("rebuilds"), F.max("losses").alias("losses"))
        return by.withColumn("pending", F.col("losses") - F.col("rebuilds") * (self._of_level(self.budgets, F.col("level")) + 1))

    def pressed(self, deletions: DataFrame) -> DataFrame:
        """deletions (problem_id, t, size): a loss for every level whose threshold the size reaches."""
        levels = F.explode(F.array(*[F.struct(F.lit(j + 1).alias("level"), F.lit(x).alias("threshold")) for j, x in enumerate(self.thresholds)]))
        return deletions.select("*", levels.alias("x")).where("size >= x.threshold").groupBy("problem_id", "x.level").agg(F.count("*").alias("losses")).withColumn("rebuilds", F.floor(F.col("losses") / (self._of_level(self.budgets, F.col("level")) + 1)))


def instability(deltas: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, moved (sum of |delta|) and instability (the same weighed by length)."""
    j = deltas.join(edges.select("problem_id", "edge_id", "length"), ["problem_id", "edge_id"])
    return j.groupBy("problem_id").agg(F.sum(F.abs("delta")).alias("moved"), F.sum(F.abs("delta") * F.col("length")).alias("instability"))


def width_update(before: DataFrame, now: DataFrame, dirty: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Widths (problem_id, edge_id, width) of two rounds and the edges touched between: the new width, and whether only touched edges have
    more than doubled, the widest one included."""
    touched = dirty.select("problem_id", "edge_id", F.lit(True).alias("dirty")).distinct()
    j = now.join(before.withColumnRenamed("width", "was"), ["problem_id", "edge_id"], "left").join(touched, ["problem_id", "edge_id"], "left")
    j = j.withColumn("dirty", F.coalesce("dirty", F.lit(False))).withColumn("was", F.coalesce("was", F.lit(0.0)))
    widest = F.max(F.struct("width", -F.col("edge_id"), "dirty"))
    out = j.groupBy("problem_id").agg(F.max("width").alias("width"), F.max("was").alias("was"), widest.alias("w"), F.every(F.col("dirty") | (F.col("width") <= 2 * F.col("was") + epsilon)).alias("edges_stable"))
    doubled = (F.col("width") <= 2 * F.col("was") + epsilon) | F.col("w.dirty")
    return out.select("problem_id", "width", doubled.alias("doubled_on_dirty"), (F.col("edges_stable") & doubled).alias("stable"))


def bits(x: Column) -> Column:
    """The number of bits of a whole value, 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(F.abs(x))))


def exactly_divided(x: Column, divisor: Column) -> Column:
    """x over the divisor; an error where a rest is left."""
    return F.when(x % divisor == 0, F.expr("0L") + (x / divisor).cast("bigint")).otherwise(F.raise_error(F.lit("a value isn't a multiple of the divisor")).cast("bigint"))


def cost_divisor(most_cost: Column, bound: Column) -> Column:
    """By what costs are divided so that none is above the bound."""
    return F.when(most_cost > bound, F.ceil(most_cost / bound)).otherwise(F.lit(1)).cast("bigint")


def cost_scaled(edges: DataFrame, bound: Column | None = None) -> DataFrame:
    """edges with costs divided, towards zero, until none is above the bound (m^3 where none is given), and the divisor."""
    facts = edges.groupBy("problem_id").agg(F.max(F.abs("cost")).alias("most"), F.count("*").alias("m"))
    limit = F.pow(F.col("m").cast("double"), F.lit(3.0)) if bound is None else bound
    facts = facts.select("problem_id", cost_divisor(F.col("most"), limit).alias("divisor"))
    return edges.join(facts, "problem_id").withColumn("cost", F.expr("cost div divisor"))


def capacity_scaled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bounds and demands over the largest power of two that divides them all, with that factor."""
    low = lambda c: F.when(F.col(c) != 0, F.col(c).bitwiseAND(-F.col(c)))
    parts = edges.select("problem_id", F.least(low("lower"), low("upper")).alias("p")).unionByName(nodes.select("problem_id", low("demand").alias("p")))
    factor = parts.groupBy("problem_id").agg(F.coalesce(F.min("p"), F.lit(1)).alias("factor"))
    over = lambda df, *names: df.join(factor, "problem_id").withColumns({c: exactly_divided(F.col(c), F.col("factor")) for c in names})
    return over(nodes, "demand"), over(edges, "lower", "upper")


def scaled_back(flow: Column, factor: Column) -> Column:
    """A fractional flow as whole units times the factor, held within 64 bits."""
    out = F.round(flow).cast("decimal(20,0)") * factor.cast("decimal(18,0)")
    return F.least(F.greatest(out, F.lit(-(2**63))), F.lit(2**63 - 1)).cast("bigint")
