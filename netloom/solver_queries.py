"""Queries of what a descent reports and decides by, over the graph of all lines, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import telemetry
from .functions.numerics import Clamps, barrier_term, guarded_inverse, guarded_log, guarded_pow
from .operators import descent, graph, spanner
from .plans import rewrite
from .queries import DAYS, FLOWED, LANES, E, _long, _region_tree, query
from .sources import tables

CLAMPS = Clamps(least_residual=2.0, most_barrier=0.25, most_gradient=0.05)


def _slacks(spark, sf_dir):
    return telemetry.residuals(tables.line_edges(spark, sf_dir), 1.0)


@query(f"{FLOWED} SELECT problem_id, count(*) FILTER (up < 1) AS up_clamped, count(*) FILTER (down < 1) AS down_clamped, sum(greatest(up, 1.0)) AS up, sum(greatest(down, 1.0)) AS down FROM g GROUP BY 1")
def residuals_lines(spark, sf_dir):
    return _slacks(spark, sf_dir).groupBy("problem_id").agg(F.count_if("up_clamped").alias("up_clamped"), F.count_if("down_clamped").alias("down_clamped"), F.sum("up").alias("up"), F.sum("down").alias("down"))


CLAMPED = """s AS (SELECT *, CASE WHEN up <= 0 THEN 0.25 ELSE least(exp(-0.5 * ln(greatest(up, 2))), 0.25) END AS barrier,
  CASE WHEN up <= 0 THEN 0.05 ELSE least(0.5 * exp(-1.5 * ln(greatest(up, 2))), 0.05) END AS gradient FROM g),
st AS (SELECT problem_id, count(*) FILTER (up <= 0 OR abs(-9 * ln(greatest(up, 1e-300))) > 20) AS power, count(*) FILTER (up < 3) AS log, count(*) FILTER (abs(up) < 4) AS inverse,
  count(*) FILTER (up < 2 OR barrier >= 0.25) AS barrier_terms, count(*) FILTER (up < 2 OR gradient >= 0.05) AS gradient_terms, min(up) AS least_residual, max(barrier) AS most_barrier FROM s {where} GROUP BY 1)"""
CLAMP_COLUMNS = "problem_id, power, log, inverse, barrier_terms, gradient_terms, least_residual, round(most_barrier, 9) AS most_barrier, power + log + inverse + barrier_terms + gradient_terms AS clamps, power + log + inverse + barrier_terms + gradient_terms > 0 AS clamped"


def _clamp_stats(edges):
    up = (F.col("upper") - F.col("flow")).cast("double")
    flags = {
        "power": telemetry.pow_clamped(up, -9, 20.0),
        "log": telemetry.log_clamped(up, 3.0),
        "inverse": telemetry.inverse_clamped(up, 4.0),
        "barrier_terms": telemetry.barrier_clamped(up, 0.5, CLAMPS),
        "gradient_terms": telemetry.gradient_clamped(up, 0.5, CLAMPS),
    }
    return telemetry.clamp_stats(edges, flags, up, barrier_term(up, 0.5, CLAMPS))


@query(f"{FLOWED}, {CLAMPED.format(where='')} SELECT {CLAMP_COLUMNS} FROM st")
def clamp_stats_lines(spark, sf_dir):
    return _clamp_stats(tables.line_edges(spark, sf_dir)).withColumn("most_barrier", F.round("most_barrier", 9))


@query(f"{FLOWED}, {CLAMPED.format(where='')} SELECT {CLAMP_COLUMNS} FROM st")
def clamp_stats_merged_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    return telemetry.merged_stats(_clamp_stats(e.where("edge_id % 2 = 0")), _clamp_stats(e.where("edge_id % 2 <> 0"))).withColumn("most_barrier", F.round("most_barrier", 9))


@query(
    f"""{FLOWED} SELECT problem_id, round(sum(CASE WHEN up <= 0 THEN 0 ELSE exp(-1.1 * ln(up)) END), 6) AS powers, round(sum(CASE WHEN up > 0 THEN ln(greatest(up, 3)) END), 6) AS logs,
  round(sum(CASE WHEN abs(up) < 4 THEN CASE WHEN up < 0 THEN -0.25 ELSE 0.25 END ELSE 1 / up END), 6) AS inverses, count(*) FILTER (l_alpha) AS alphas
FROM (SELECT *, up / 10 < 1e-6 OR up / 10 > 0.999 AS l_alpha FROM g) GROUP BY 1"""
)
def guarded_lines(spark, sf_dir):
    up = (F.col("upper") - F.col("flow")).cast("double")
    total = lambda x, name: F.round(F.sum(x), 6).alias(name)
    return tables.line_edges(spark, sf_dir).groupBy("problem_id").agg(total(guarded_pow(up, -1.1), "powers"), total(F.when(up > 0, guarded_log(up, 3.0)), "logs"), total(guarded_inverse(up, 4.0), "inverses"), F.count_if(telemetry.alpha_clamped(up / 10)).alias("alphas"))


FACTS = f"{E}, f AS (SELECT problem_id, count(*) AS m, max(upper) AS u, CAST(sum(cost) AS DOUBLE) AS p, count(DISTINCT src) + count(DISTINCT dst) AS n FROM e GROUP BY 1)"


@query(
    f"""WITH {FACTS} SELECT problem_id, m <= 12 OR n <= 8 AS classic, CAST(ceil(sqrt(m) * greatest(ln(m / 0.1), 1)) AS BIGINT) AS iterations, m <= ceil(sqrt(m) * greatest(ln(m / 0.1), 1)) AS almost_linear, m % 2 = 0 AND m > 2000 AS falls_back,
  round(-200.0 * m * greatest(ln(m * u), 1), 6) AS target, round(1e9 * least(greatest(abs(p), 1) / greatest(pow(greatest(ln(m * u), 2), 3) * m, 1), 1e-6), 6) AS floor, round(1 / greatest(ln(m), 2), 9) AS kappa, 1e-40 <= pow(m * u, -10.0) AS terminates FROM f"""
)
def thresholds_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    f = e.groupBy("problem_id").agg(F.count("*").alias("m"), F.max("upper").alias("u"), F.sum("cost").cast("double").alias("p"), (F.count_distinct("src") + F.count_distinct("dst")).alias("n"))
    m, u = F.col("m"), F.col("u")
    end = F.when(m % 2 == 0, "ITERATION_LIMIT").otherwise("GAP")
    return f.select(
        "problem_id",
        telemetry.classic_chosen(m, F.col("n")).alias("classic"),
        telemetry.iterations_for(m, 0.1).alias("iterations"),
        telemetry.almost_linear(m, m, 0.1).alias("almost_linear"),
        telemetry.falls_back(end, m, F.lit(1000)).alias("falls_back"),
        F.round(telemetry.termination_target(m, u), 6).alias("target"),
        F.round(1e9 * telemetry.reduction_floor(F.col("p"), m, u), 6).alias("floor"),
        F.round(telemetry.kappa_floor(m), 9).alias("kappa"),
        telemetry.terminates(F.lit(1e-40), m, u).alias("terminates"),
    )


@query(
    f"""{FLOWED}, b AS (SELECT problem_id, count(*) AS m, max(upper) AS u, CAST(sum(flow * cost) AS DOUBLE) AS c, sum(CASE WHEN up < 1e-12 THEN exp(LEAST(0.5 * -ln(1e-12), 50)) ELSE exp(-0.5 * ln(up)) END + CASE WHEN down < 1e-12 THEN exp(0.5 * -ln(1e-12)) ELSE exp(-0.5 * ln(down)) END) AS s FROM g GROUP BY 1),
x AS (SELECT *, greatest(abs(c), 1, u) AS scale FROM b) SELECT problem_id, round(scale * exp(-(m * ln(scale) + 0.5 * s) / (20.0 * m)), 6) AS estimate FROM x"""
)
def gap_estimate_lines(spark, sf_dir):
    return telemetry.gap_estimates(tables.line_edges(spark, sf_dir), 0.5).withColumn("estimate", F.round("estimate", 6))


@query(
    f"""WITH {FACTS}, x AS (SELECT problem_id, n, m, greatest(floor(pow(ln(m), 0.25)), 1) AS depth, 1 / greatest(ln(n) * ln(n), 1) AS epsilon FROM f)
SELECT problem_id, CAST(depth AS BIGINT) AS depth, round(epsilon, 9) AS epsilon, CAST(greatest(ceil(sqrt(ln(n))), 1) AS BIGINT) AS levels, round(greatest(ln(n) * ln(n), 1) * (1 + epsilon), 6) AS stretch, round(ln(n), 6) AS congestion, round(pow(n, 1 / depth), 6) AS recourse, CAST(ceil(pow(n, 1 / depth)) AS BIGINT) AS recourse_limit FROM x"""
)
def spanner_parameters_lines(spark, sf_dir):
    f = tables.line_edges(spark, sf_dir).groupBy("problem_id").agg(F.count("*").alias("m"), (F.count_distinct("src") + F.count_distinct("dst")).alias("n"))
    places = {"epsilon": 9, "stretch": 6, "congestion": 6, "recourse": 6}
    found = telemetry.spanner_parameters(F.col("n"), F.col("m"))
    return f.select("problem_id", *[(F.round(c, places[k]) if k in places else c.cast("bigint")).alias(k) for k, c in found.items()])


#: A game per event type: its events in order are the rounds, lost where the value is low.
ROUNDS = "r AS (SELECT event_type AS problem_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS t, value >= 20 AS won, CAST(value AS DOUBLE) AS amount, event_id FROM events)"


def _rounds(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.selectExpr("event_type AS problem_id", "CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS t", "value >= 20 AS won", "CAST(value AS DOUBLE) AS amount")


GAME = telemetry.Game(1000, 5000, 3)
_T, _B = GAME.thresholds, GAME.budgets
PLAYED = f"""{ROUNDS}, l AS (SELECT *, CASE WHEN t % {_T[0]} = 0 THEN 1 WHEN t % {_T[1]} = 0 THEN 2 ELSE 3 END AS level FROM r),
c AS (SELECT *, CAST(sum(CASE WHEN won THEN 0 ELSE 1 END) OVER (PARTITION BY problem_id, level ORDER BY t) AS BIGINT) AS losses FROM l),
p AS (SELECT *, NOT won AND losses % (([{_B[0]}, {_B[1]}, {_B[2]}])[level] + 1) = 0 AS rebuild FROM c)"""


@query(f"WITH {PLAYED} SELECT problem_id, t, won, level, losses, rebuild FROM p WHERE rebuild")
def game_rebuilds_events(spark, sf_dir):
    return GAME.played(_rounds(spark, sf_dir)).where("rebuild").drop("amount")


@query(
    f"""WITH {PLAYED} SELECT problem_id, level, count(*) AS rounds, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 9) AS win_rate, count(*) FILTER (rebuild) AS rebuilds, max(losses) AS losses,
  max(losses) - count(*) FILTER (rebuild) * (([{_B[0]}, {_B[1]}, {_B[2]}])[level] + 1) AS pending FROM p GROUP BY 1, 2"""
)
def game_stats_events(spark, sf_dir):
    return GAME.stats(_rounds(spark, sf_dir)).withColumn("win_rate", F.round("win_rate", 9))


@query(f"WITH {ROUNDS}, x AS (SELECT problem_id, CAST(value AS BIGINT) AS size FROM (SELECT event_type AS problem_id, value FROM events)) SELECT problem_id, level, count(*) AS losses, count(*) // (budget + 1) AS rebuilds FROM x JOIN (VALUES (1, {_T[0]}, {_B[0]}), (2, {_T[1]}, {_B[1]}), (3, {_T[2]}, {_B[2]})) v(level, threshold, budget) ON size >= threshold GROUP BY 1, 2, budget")
def game_pressure_events(spark, sf_dir):
    # DuckDB's cast sends halves to the even neighbour.
    sizes = tables.table(spark, sf_dir, "events").selectExpr("event_type AS problem_id", "event_id AS t", "CAST(rint(value) AS BIGINT) AS size")
    return GAME.pressed(sizes).withColumn("rebuilds", F.col("rebuilds").cast("bigint"))


@query(
    f"""WITH {ROUNDS}, s AS (SELECT problem_id, t, sum(CAST(round(greatest(amount, 0)) AS BIGINT)) OVER (PARTITION BY problem_id ORDER BY t) AS spent FROM r),
d AS (SELECT *, spent // 500 AS rebuilds, coalesce(lag(spent // 500) OVER (PARTITION BY problem_id ORDER BY t), 0) AS was FROM s)
SELECT problem_id, t, CAST(spent AS BIGINT) AS spent, CAST(rebuilds AS BIGINT) AS rebuilds FROM d WHERE rebuilds > was"""
)
def budget_rebuilds_events(spark, sf_dir):
    updates = _rounds(spark, sf_dir).withColumn("amount", F.round("amount"))
    return telemetry.budget_rebuilds(updates, 500.0).where("due").select("problem_id", "t", _long("spent"), _long("rebuilds"))


@query(f"WITH {ROUNDS} SELECT problem_id, count(*) FILTER (t % 25 = 0 OR amount >= 90) AS due, count(*) FILTER (t % 25 = 0) AS periodic FROM r GROUP BY 1")
def rebuild_due_events(spark, sf_dir):
    t, amount = F.col("t"), F.col("amount")
    return _rounds(spark, sf_dir).groupBy("problem_id").agg(F.count_if(telemetry.rebuild_due(t, amount, 25, 90.0)).alias("due"), F.count_if(telemetry.rebuild_due(t, amount, 25)).alias("periodic"))


@query(f"WITH {E} SELECT problem_id, round(CASE WHEN sum(cost + 5) = 0 THEN 0 ELSE sum(upper) / sum(cost + 5) END, 9) AS updates_per_query FROM e GROUP BY 1")
def amortized_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir).withColumn("asked", F.col("cost") + 5)
    return telemetry.amortized(e, "upper", "asked").withColumn("updates_per_query", F.round("updates_per_query", 9))


@query(f"WITH {E} SELECT problem_id, CAST(sum(abs(flow - 3)) AS BIGINT) AS moved, CAST(sum(abs(flow - 3) * upper) AS BIGINT) AS instability FROM e GROUP BY 1")
def instability_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    deltas = e.select("problem_id", "edge_id", (F.col("flow") - 3).alias("delta"))
    found = telemetry.instability(deltas, e.withColumn("length", F.col("upper")))
    return found.select("problem_id", _long("moved"), _long("instability"))


@query(
    f"""WITH {E}, w AS (SELECT problem_id, edge_id, abs(cost) AS width, flow AS was, edge_id % 3 <> 0 AS dirty FROM e),
x AS (SELECT problem_id, max(width) AS width, max(was) AS was, arg_max(dirty, width * 1e18 - edge_id) AS d, bool_and(dirty OR width <= 2 * was + 1e-9) AS ok FROM w GROUP BY 1)
SELECT problem_id, CAST(width AS BIGINT) AS width, width <= 2 * was + 1e-9 OR d AS doubled_on_dirty, ok AND (width <= 2 * was + 1e-9 OR d) AS stable FROM x"""
)
def width_update_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    now = e.select("problem_id", "edge_id", F.abs("cost").alias("width"))
    return telemetry.width_update(e.select("problem_id", "edge_id", F.col("flow").alias("width")), now, e.where("edge_id % 3 <> 0")).withColumn("width", _long("width"))


@query(f"WITH {E}, f AS (SELECT problem_id, max(abs(cost)) AS c FROM e GROUP BY 1) SELECT problem_id, CAST(sum(CASE WHEN cost >= 0 THEN cost // CAST(ceil(c / 2) AS BIGINT) ELSE -(-cost // CAST(ceil(c / 2) AS BIGINT)) END) AS BIGINT) AS costs, CAST(any_value(ceil(c / 2)) AS BIGINT) AS divisor, CAST(sum(CASE WHEN cost = 0 THEN 0 ELSE floor(log2(abs(cost))) + 1 END) AS BIGINT) AS bits FROM e JOIN f USING (problem_id) GROUP BY 1")
def cost_scaled_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir).withColumn("bits", telemetry.bits(F.col("cost")))
    return telemetry.cost_scaled(e, F.lit(2)).groupBy("problem_id").agg(F.sum("cost").alias("costs"), F.first("divisor").alias("divisor"), F.sum("bits").cast("bigint").alias("bits"))


@query(f"WITH {E} SELECT problem_id, CAST(sum(lower) AS BIGINT) AS lowers, CAST(sum(upper) AS BIGINT) AS uppers, CAST(8 AS BIGINT) AS factor, CAST(sum(8 * lower) AS BIGINT) AS back FROM e GROUP BY 1")
def capacity_scaled_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir).withColumn("lower", F.col("lower") * 8).withColumn("upper", F.col("upper") * 8)
    nodes = e.select("problem_id", F.lit(16).cast("bigint").alias("demand")).distinct()
    _, edges = telemetry.capacity_scaled(nodes, e)
    back = telemetry.scaled_back(F.col("lower").cast("double"), F.col("factor"))
    return edges.groupBy("problem_id").agg(F.sum("lower").alias("lowers"), F.sum("upper").alias("uppers"), F.max("factor").alias("factor"), F.sum(back).alias("back"))


@query(f"WITH {DAYS} SELECT CAST(sum((1 + d % 3) * abs(pre)) AS BIGINT) AS total_cost, 'OPTIMAL' AS status FROM p WHERE d < k - 1")
def ipm_day_line(spark, sf_dir):
    return descent.descend(*tables.day_line(spark, sf_dir), 8).solutions.select(_long("cost", "total_cost"), "status")


@query(f"WITH {LANES} SELECT problem_id, CAST(sum(cost * least(greatest(half - before, 0), cap)) AS BIGINT) AS total_cost FROM q GROUP BY 1")
def ipm_lanes(spark, sf_dir):
    return descent.descend(*tables.order_lanes(spark, sf_dir)).solutions.select("problem_id", _long("cost", "total_cost"))


@query(f"WITH {LANES} SELECT DISTINCT problem_id, 'ipm' AS solver_mode, CAST(6 AS INT) AS iterations, TRUE AS falls FROM q")
def ipm_steps_lanes(spark, sf_dir):
    """What the steps themselves do: all six are taken in every lane, and each lowers the potential (the gap alone may grow, when a step leaves a bound)."""
    s = descent.descend(*tables.order_lanes(spark, sf_dir), 6).stats
    return s.select("problem_id", "solver_mode", "iterations", (F.col("drop") > 0).alias("falls"))


@query(f"WITH {DAYS} SELECT CAST(2 * d + CASE WHEN pre < 0 THEN 0 ELSE 1 END AS BIGINT) AS edge_id, CAST(abs(pre) AS BIGINT) AS flow FROM p WHERE d < k - 1 AND pre <> 0")
def cancelled_cycles_day_line(spark, sf_dir):
    """From a feasible flow that sends one unit both ways everywhere."""
    nodes, edges = tables.day_line(spark, sf_dir)
    start = descent.feasible_start(nodes, edges).flows.join(edges.select("problem_id", "edge_id"), ["problem_id", "edge_id"]).withColumn("flow", F.col("flow") + 1)
    return descent.cancelled(nodes, edges, start).flows.where("flow > 0").select("edge_id", "flow")


@query(f"WITH {DAYS} SELECT 'days' AS problem_id, CAST(sum((1 + d % 3) * abs(pre)) AS BIGINT) AS total_cost, true AS balanced FROM p WHERE d < k - 1")
def rounded_day_line(spark, sf_dir):
    """The optimum, spoilt by half a unit both ways, comes back."""
    nodes, edges = tables.day_line(spark, sf_dir)
    spoilt = descent.cancelled(nodes, edges, descent.feasible_start(nodes, edges).flows).flows.withColumn("flow", F.col("flow") + F.lit(0.5))
    out = descent.finalized(nodes, edges, spoilt)
    return out.solutions.select("problem_id", _long("cost", "total_cost"), (F.col("status") == "OPTIMAL").alias("balanced"))


@query(f"WITH {E} SELECT problem_id, count(*) AS edges, CAST(sum(lower + upper) AS BIGINT) AS doubled, count(*) FILTER (flow <> greatest(least(flow, upper - 1), lower + 1)) AS moved FROM e GROUP BY 1")
def inside_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    kept = rewrite.clamped_flow(e, 1.0).select("problem_id", "edge_id", "moved")
    middle = rewrite.midpoints(e).withColumnRenamed("flow", "middle")
    return middle.join(kept, ["problem_id", "edge_id"]).groupBy("problem_id").agg(F.count("*").alias("edges"), F.sum(2 * F.col("middle")).cast("bigint").alias("doubled"), F.count_if("moved").alias("moved"))


#: Suppliers and parts whose number divides by 7 are centers.
CLUSTERS = f"""{E}, b AS (SELECT problem_id, edge_id, src AS x, dst AS y FROM e UNION ALL SELECT problem_id, edge_id, dst, src FROM e),
n AS (SELECT DISTINCT problem_id, x AS node_id FROM b),
j AS (SELECT problem_id, x AS node_id, arg_min(y, (y, edge_id)) AS cluster, arg_min(edge_id, (y, edge_id)) AS edge_id FROM b WHERE y % 7 = 0 GROUP BY 1, 2),
c AS (SELECT n.problem_id, n.node_id, CASE WHEN n.node_id % 7 = 0 OR j.cluster IS NULL THEN n.node_id ELSE j.cluster END AS cluster, CASE WHEN n.node_id % 7 <> 0 THEN j.edge_id END AS edge_id FROM n LEFT JOIN j USING (problem_id, node_id))"""


def _clusters(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    centers = e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().where("node_id % 7 = 0")
    return e, spanner.clusters(e, centers)


@query(f"WITH {CLUSTERS} SELECT problem_id, node_id, cluster, edge_id FROM c")
def clusters_lines(spark, sf_dir):
    return _clusters(spark, sf_dir)[1]


@query(f"WITH {CLUSTERS}, l AS (SELECT b.problem_id, min(b.edge_id) AS edge_id FROM b JOIN c p ON p.problem_id = b.problem_id AND p.node_id = b.x JOIN c q ON q.problem_id = b.problem_id AND q.node_id = b.y WHERE p.cluster <> q.cluster GROUP BY b.problem_id, b.x, q.cluster) SELECT problem_id, edge_id FROM c WHERE edge_id IS NOT NULL UNION SELECT problem_id, edge_id FROM l")
def cluster_spanner_lines(spark, sf_dir):
    return spanner.cluster_spanner(*_clusters(spark, sf_dir))


@query(f"WITH {CLUSTERS}, k AS (SELECT e.problem_id, least(p.cluster, q.cluster) AS u, greatest(p.cluster, q.cluster) AS v, min(upper) AS length FROM e JOIN c p ON p.problem_id = e.problem_id AND p.node_id = e.src JOIN c q ON q.problem_id = e.problem_id AND q.node_id = e.dst WHERE p.cluster <> q.cluster GROUP BY 1, 2, 3) SELECT problem_id, count(*) AS edges, CAST(sum(length) AS BIGINT) AS lengths FROM k GROUP BY 1")
def cluster_graph_lines(spark, sf_dir):
    e, found = _clusters(spark, sf_dir)
    return spanner.next_level(e.withColumn("length", F.col("upper")), found).groupBy("problem_id").agg(F.count("*").alias("edges"), F.sum("length").alias("lengths"))


@query(f"WITH {CLUSTERS} SELECT e.problem_id, count(*) AS edges, CAST(sum(CASE WHEN p.edge_id IS NULL THEN 0 ELSE 1 END + CASE WHEN q.edge_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS steps FROM e JOIN c p ON p.problem_id = e.problem_id AND p.node_id = e.src JOIN c q ON q.problem_id = e.problem_id AND q.node_id = e.dst WHERE p.cluster = q.cluster GROUP BY 1")
def cluster_steps_lines(spark, sf_dir):
    e, found = _clusters(spark, sf_dir)
    return spanner.steps(found, e).groupBy("problem_id").agg(F.count("*").alias("edges"), F.sum("within").alias("steps"))


@query(f"WITH {E} SELECT problem_id, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY edge_id) AS k FROM e) WHERE k <= 50")
def pruned_lines(spark, sf_dir):
    return spanner.pruned(tables.line_edges(spark, sf_dir), 50).select("problem_id", "edge_id")


@query("SELECT CAST(4 AS BIGINT) AS edges, CAST(1 AS BIGINT) AS components FROM (SELECT count(DISTINCT n_regionkey) AS n FROM nation) WHERE n = 5")
def random_forest_regions(spark, sf_dir):
    nodes, e, _ = _region_tree(spark, sf_dir)
    forest = spanner.random_forest(nodes, e, 7)
    parts = graph.connected(nodes, forest)
    return forest.agg(F.count("*").alias("edges")).crossJoin(parts.agg(F.count_distinct("component").alias("components")))
