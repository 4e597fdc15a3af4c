"""Queries of the flow engine over the star-schema tables, each with the same result in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import convex, numerics
from .operators import graph, reductions
from .operators.solve import certify, flow_cost, merge_parallel, nested_flows, solve
from .plans import problem, rewrite
from .sources import tables
from .streaming import deltas

QUERIES: dict = {}
SQL: dict[str, str] = {}
E = tables.LINE_EDGE_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(c, name=None):
    return F.col(c).cast("bigint").alias(name or c)


DAYS = """days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS c FROM events GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS d, c, sum(c) OVER () AS tot, count(*) OVER () AS k FROM days),
dem AS (SELECT d, k, CAST(tot * (d + 1) // k - tot * d // k - c AS BIGINT) AS demand FROM n),
p AS (SELECT d, k, demand, sum(demand) OVER (ORDER BY d) AS pre FROM dem)"""


@query(f"WITH {DAYS} SELECT CAST(sum((1 + d % 3) * abs(pre)) AS BIGINT) AS total_cost, 'OPTIMAL' AS status FROM p WHERE d < k - 1")
def flow_day_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve(*tables.day_line(spark, sf_dir)).solutions.select(_long("cost", "total_cost"), "status")


@query(f"WITH {DAYS} SELECT CAST(2 * d + CASE WHEN pre < 0 THEN 0 ELSE 1 END AS BIGINT) AS edge_id, CAST(abs(pre) AS BIGINT) AS flow FROM p WHERE d < k - 1 AND pre <> 0")
def flow_day_line_flows(spark, sf_dir):
    return solve(*tables.day_line(spark, sf_dir)).flows.where("flow > 0").select("edge_id", "flow")


@query("SELECT 'days' AS problem_id, CAST(0 AS BIGINT) AS bounds, CAST(0 AS BIGINT) AS balance, CAST(0 AS BIGINT) AS reduced_costs")
def flow_certificate(spark, sf_dir):
    nodes, edges = tables.day_line(spark, sf_dir)
    return certify(nodes, edges, solve(nodes, edges))


LANES = """o AS (SELECT CAST(c_nationkey AS VARCHAR) AS problem_id, o_orderkey, CAST(day(o_orderdate) AS BIGINT) AS cap, CAST(floor(o_totalprice) AS BIGINT) AS cost
  FROM orders JOIN customer ON o_custkey = c_custkey),
q AS (SELECT *, sum(cap) OVER (PARTITION BY problem_id ORDER BY cost, o_orderkey) - cap AS before, sum(cap) OVER (PARTITION BY problem_id) // 2 AS half FROM o)"""


@query(f"WITH {LANES} SELECT problem_id, CAST(sum(cost * least(greatest(half - before, 0), cap)) AS BIGINT) AS total_cost FROM q GROUP BY 1")
def flow_parallel_lanes(spark, sf_dir):
    return solve(*tables.order_lanes(spark, sf_dir)).solutions.select("problem_id", _long("cost", "total_cost"))


@query(f"WITH {LANES} SELECT problem_id, CAST(sum(cost * least(greatest(half - before, 0), cap)) AS BIGINT) AS cost FROM q GROUP BY 1")
def flow_cost_of_flows(spark, sf_dir):
    nodes, edges = tables.order_lanes(spark, sf_dir)
    return flow_cost(edges, solve(nodes, edges).flows).select("problem_id", _long("cost"))


@query(f"WITH {LANES} SELECT problem_id, CAST(0 AS BIGINT) AS src, CAST(1 AS BIGINT) AS dst, CAST(any_value(half) AS BIGINT) AS flow FROM q GROUP BY 1")
def flow_nested(spark, sf_dir):
    nodes, edges = tables.order_lanes(spark, sf_dir)
    out = nested_flows(edges, solve(nodes, edges).flows)
    return out.select("problem_id", "src", F.explode("flows").alias("dst", "flow"))


CONVEX = """e AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS edge_id, n_nationkey % 7 + 1 AS cap, n_regionkey + 1 AS w FROM nation),
u AS (SELECT edge_id, w, unnest(range(1, cap + 1)) AS unit FROM e),
m AS (SELECT edge_id, CAST(w * (unit * unit - (unit - 1) * (unit - 1)) AS BIGINT) AS c FROM u),
r AS (SELECT c, row_number() OVER (ORDER BY c) AS i, count(*) OVER () // 2 AS half FROM m)"""


@query(f"WITH {CONVEX} SELECT CAST(sum(c) AS BIGINT) AS total FROM r WHERE i <= half")
def flow_convex(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation")
    zero = F.lit(0).cast("bigint")
    edges = n.select(F.lit("c").alias("problem_id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n_nationkey")).cast("bigint").alias("edge_id"), zero.alias("src"), F.lit(1).cast("bigint").alias("dst"), zero.alias("lower"), (F.col("n_nationkey") % 7 + 1).cast("bigint").alias("upper"), zero.alias("cost"), (F.col("n_regionkey") + 1).alias("w"))
    nodes = edges.groupBy("problem_id").agg(F.expr("sum(upper) div 2").alias("h")).selectExpr("problem_id", "stack(2, 0L, -h, 1L, h) AS (node_id, demand)")
    flows = reductions.convex_flow(nodes, edges, rewrite.marginal("p_norm", F.col("unit"), F.col("w"), 2.0))
    total = flows.join(edges.select("edge_id", "w"), "edge_id").agg(F.sum(F.col("w") * F.col("flow") * F.col("flow")).cast("bigint").alias("total"))
    return total


SUBSETS = f"""WITH {tables.REGION_SQL},
b AS (SELECT unnest(range(0, 32)) AS s),
c AS (SELECT s, sum(CASE WHEN (s >> src) & 1 = 1 AND (s >> dst) & 1 = 0 THEN capacity ELSE 0 END) AS d,
  sum(CASE WHEN (s >> src) & 1 <> (s >> dst) & 1 THEN capacity ELSE 0 END) AS cut FROM b, r GROUP BY s)"""


@query(f"{SUBSETS} SELECT CAST(min(d) AS BIGINT) AS value FROM c WHERE s & 1 = 1 AND (s >> 4) & 1 = 0")
def max_flow_regions(spark, sf_dir):
    ends = spark.createDataFrame([("regions", 0, 4)], "problem_id string, source bigint, sink bigint")
    return reductions.max_flow(tables.region_pairs(spark, sf_dir), ends).where("kind = 'value'").select("value")


@query(f"{SUBSETS} SELECT u, v, CAST(min(cut) AS BIGINT) AS cut FROM c, (SELECT unnest(range(0, 5)) AS u) a, (SELECT unnest(range(0, 5)) AS v) z WHERE u < v AND (s >> u) & 1 = 1 AND (s >> v) & 1 = 0 GROUP BY u, v")
def gomory_hu_cuts(spark, sf_dir):
    return reductions.pairwise_cuts(reductions.cut_facts(tables.region_pairs(spark, sf_dir))).select("u", "v", "cut")


@query(
    f"""{SUBSETS}, m AS (SELECT u, v, min(cut) AS cut FROM c, (SELECT unnest(range(0, 5)) AS u) a, (SELECT unnest(range(0, 5)) AS v) z WHERE u < v AND (s >> u) & 1 = 1 AND (s >> v) & 1 = 0 GROUP BY u, v),
w AS (SELECT bit_count(s) AS k, c.cut FROM c JOIN m ON m.cut = c.cut AND (s >> u) & 1 = 1 AND (s >> v) & 1 = 0)
SELECT round(min(cut / least(k, 5 - k)), 6) AS ratio, CAST(4 AS BIGINT) AS vertex_connectivity FROM w"""
)
def sparsest_cut(spark, sf_dir):
    facts = reductions.cut_facts(tables.region_pairs(spark, sf_dir))
    return facts.select(F.round("sparsest_ratio", 6).alias("ratio"), "vertex_connectivity")


@query(
    f"""WITH {tables.REGION_SQL}, w AS (SELECT src, dst, capacity % 1009 AS w FROM r),
SELECT CAST(min(a.w + b.w + c.w + d.w + e.w) AS BIGINT) AS total, CAST(5 AS BIGINT) AS pairs FROM w a, w b, w c, w d, w e
WHERE a.src = 0 AND b.src = 1 AND c.src = 2 AND d.src = 3 AND e.src = 4 AND len(list_distinct([a.dst, b.dst, c.dst, d.dst, e.dst])) = 5""".replace("r),\nSELECT", "r)\nSELECT")
)
def matching_regions(spark, sf_dir):
    pairs = tables.region_pairs(spark, sf_dir).select("problem_id", F.col("src").alias("left"), (F.col("dst") + 10).alias("right"), (F.col("capacity") % 1009).alias("weight"))
    return reductions.matching(pairs).join(pairs, ["problem_id", "left", "right"]).agg(F.sum("weight").alias("total"), F.count("*").alias("pairs"))


WALKS = f"""WITH RECURSIVE {tables.TRANSITION_SQL},
w AS (SELECT src AS a, src AS v, CAST(0 AS BIGINT) AS d, 0 AS i FROM (SELECT DISTINCT src FROM t) UNION SELECT a, v, min(d) AS d, i FROM (
  SELECT w.a, t.dst AS v, w.d + COSTCOL AS d, w.i + 1 AS i FROM w JOIN t ON t.src = w.v WHERE w.i < STEPS) GROUP BY a, v, i)"""


@query(WALKS.replace("COSTCOL", "t.cost + 3").replace("STEPS", "4") + " SELECT v AS node_id, min(d) AS distance FROM w WHERE a = 1 GROUP BY v")
def shortest_paths_events(spark, sf_dir):
    t = tables.transitions(spark, sf_dir).withColumn("cost", F.col("cost") + 3)
    start = spark.createDataFrame([("events", 1)], "problem_id string, node_id bigint")
    return graph.shortest_paths(t, start).select("node_id", "distance")


@query(WALKS.replace("COSTCOL", "1").replace("STEPS", "4") + " SELECT v AS node_id, min(d) AS hops FROM w WHERE a = 1 GROUP BY v")
def breadth_first_events(spark, sf_dir):
    start = spark.createDataFrame([("events", 1)], "problem_id string, node_id bigint")
    return graph.hops(tables.transitions(spark, sf_dir), start).select("node_id", F.col("distance").alias("hops"))


@query(WALKS.replace("COSTCOL", "t.cost").replace("STEPS", "5") + " SELECT count(*) > 0 AS negative_cycle FROM w WHERE a = v AND d < 0")
def negative_cycle_events(spark, sf_dir):
    return graph.has_negative_cycle(tables.transitions(spark, sf_dir)).select("negative_cycle")


@query(WALKS.replace("COSTCOL", "t.cost").replace("STEPS", "5") + " SELECT CAST(count(*) > 0 AS INT) AS found, CAST(0 AS BIGINT) AS not_negative FROM w WHERE a = v AND d < 0")
def negative_cycle_walk(spark, sf_dir):
    t = tables.transitions(spark, sf_dir)
    steps = reductions.negative_cycles(t).select("problem_id", F.explode("cycle").alias("edge_id")).join(t, ["problem_id", "edge_id"])
    total = steps.groupBy("problem_id").agg(F.sum("cost").alias("total"))
    return total.agg(F.count("*").cast("int").alias("found"), F.count_if(F.col("total") >= 0).alias("not_negative"))


@query(f"WITH {tables.TRANSITION_SQL} SELECT src, dst, src * 100 + dst AS edge_id FROM t WHERE cost < 0 ORDER BY edge_id LIMIT 1")
def first_negative_edge_events(spark, sf_dir):
    return graph.first_negative_edge(tables.transitions(spark, sf_dir)).select("src", "dst", "edge_id")


TREE = f"""WITH RECURSIVE {tables.REGION_SQL}, e AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(capacity % 997 + 1) AS w, min(src * 5 + dst) AS i FROM r WHERE src < dst GROUP BY 1, 2),
reach AS (SELECT e.i, e.u AS at FROM e UNION SELECT r.i, CASE WHEN f.u = r.at THEN f.v ELSE f.u END FROM reach r JOIN e x ON x.i = r.i JOIN e f ON (f.u = r.at OR f.v = r.at) AND (f.w, f.i) < (x.w, x.i)),
m AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.i = e.i AND r.at = e.v))"""


def _region_tree(spark, sf_dir):
    e = tables.region_pairs(spark, sf_dir).where("src < dst").withColumn("length", F.col("capacity") % 997 + 1)
    nodes = tables.table(spark, sf_dir, "region").select(F.lit("regions").alias("problem_id"), F.col("r_regionkey").cast("bigint").alias("node_id"))
    return nodes, e, graph.spanning_forest(nodes, e)


@query(f"{TREE} SELECT i AS edge_id, w AS length FROM m")
def spanning_forest_regions(spark, sf_dir):
    return _region_tree(spark, sf_dir)[2].select("edge_id", "length")


PATHS = TREE + """, p AS (SELECT x.n AS a, x.n AS v, CAST(0 AS DOUBLE) AS d, [x.n] AS seen FROM (SELECT unnest(range(0, 5)) AS n) x
  UNION ALL SELECT p.a, CASE WHEN m.u = p.v THEN m.v ELSE m.u END, p.d + m.w, list_append(p.seen, CASE WHEN m.u = p.v THEN m.v ELSE m.u END)
  FROM p JOIN m ON m.u = p.v OR m.v = p.v WHERE NOT list_contains(p.seen, CASE WHEN m.u = p.v THEN m.v ELSE m.u END))"""


@query(f"{PATHS} SELECT e.i AS edge_id, round(p.d / e.w, 6) AS stretch FROM e JOIN p ON p.a = e.u AND p.v = e.v")
def tree_stretch_regions(spark, sf_dir):
    nodes, e, forest = _region_tree(spark, sf_dir)
    return graph.stretch(graph.rooted(nodes, forest), e).select("edge_id", F.round("stretch", 6).alias("stretch"))


@query(f"{PATHS} SELECT v AS node_id, len(seen) - 1 AS depth, CAST(d AS BIGINT) AS prefix_length FROM p WHERE a = 0")
def rooted_tree_regions(spark, sf_dir):
    nodes, e, forest = _region_tree(spark, sf_dir)
    return graph.rooted(nodes, forest).select("node_id", _long("depth"), _long("prefix_length"))


@query(f"{PATHS} SELECT e.i AS edge_id FROM e JOIN p ON p.a = e.u AND p.v = e.v WHERE p.d / e.w > 1.5")
def tree_spanner_regions(spark, sf_dir):
    nodes, e, forest = _region_tree(spark, sf_dir)
    return graph.spanner(graph.stretch(graph.rooted(nodes, forest), e), 1.5).select("edge_id")


@query(f"{PATHS} SELECT e.i AS edge_id, CAST(p.d + e.w AS BIGINT) AS length FROM e JOIN p ON p.a = e.u AND p.v = e.v WHERE e.i NOT IN (SELECT i FROM m)")
def fundamental_cycle_lengths(spark, sf_dir):
    nodes, e, forest = _region_tree(spark, sf_dir)
    values = e.select("problem_id", "edge_id", (F.col("capacity") % 7 - 3).alias("gradient"), "length")
    return graph.cycle_scores(graph.cycles(graph.rooted(nodes, forest), e), values).select("edge_id", _long("length"))


# Each round keeps, by node, the least label known so far, so that the recursion takes as many rounds as the graph is wide.
LINES_COMPONENTS = """WITH RECURSIVE x AS MATERIALIZED (SELECT DISTINCT l_suppkey AS s, 1000000 + l_partkey AS p FROM lineitem),
e AS MATERIALIZED (SELECT s AS a, p AS b FROM x UNION SELECT p, s FROM x),
r(node_id, component) USING KEY (node_id) AS (SELECT DISTINCT a, a FROM e
UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.node_id JOIN recurring.r AS o ON o.node_id = e.b WHERE r.component < o.component GROUP BY e.b)
SELECT node_id, component FROM r"""


@query(LINES_COMPONENTS)
def components_lines(spark, sf_dir):
    e = tables.table(spark, sf_dir, "lineitem").select(F.lit("0").alias("problem_id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).distinct()
    nodes = e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return graph.connected(nodes, e).select("node_id", "component")


@query(f"WITH {DAYS}, i AS (SELECT d + 1 AS d, c FROM n), j AS (SELECT a.d AS j, b.d AS k, avg(x.c) AS m FROM i a JOIN i b ON a.d <= b.d JOIN i x ON x.d BETWEEN a.d AND b.d GROUP BY 1, 2) SELECT i.d - 1 AS node_id, round(max(l.low), 6) AS fitted FROM i JOIN (SELECT j, p.d AS d, min(m) AS low FROM j JOIN i p ON j.j <= p.d AND j.k >= p.d GROUP BY 1, 2) l ON l.d = i.d GROUP BY i.d")
def isotonic_days(spark, sf_dir):
    return reductions.isotonic_chain(_day_values(spark, sf_dir)).select("node_id", F.round("fitted", 6).alias("fitted"))


def _day_values(spark, sf_dir):
    days = tables.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    return days.select(F.lit("days").alias("problem_id"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")) - 1).cast("bigint").alias("node_id"), F.col("c").cast("double").alias("value"), F.lit(1.0).alias("weight"))


@query(SQL["isotonic_days"])
def isotonic_days_by_cuts(spark, sf_dir):
    v = _day_values(spark, sf_dir)
    edges = v.select("problem_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst")).join(v.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return reductions.isotonic_dag(v, edges).select("node_id", F.round("fitted", 6).alias("fitted"))


@query(f"WITH {DAYS} SELECT d AS node_id, CAST(max(c) OVER (ORDER BY d) AS BIGINT) AS raised FROM n")
def isotonic_max_days(spark, sf_dir):
    v = _day_values(spark, sf_dir)
    edges = v.select("problem_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst")).join(v.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return reductions.isotonic_max(v, edges).select("node_id", _long("raised"))


def _sinkhorn_sql() -> str:
    steps = []
    steps.append("y0 AS (SELECT DISTINCT dst, 1.0::DOUBLE AS y FROM r)")
    for k in range(50):
        steps.append(f"x{k + 1} AS MATERIALIZED (SELECT src, 1.0 / greatest(sum(a * y), 1e-12) AS x FROM a JOIN y{k} USING (dst) GROUP BY src)")
        steps.append(f"y{k + 1} AS MATERIALIZED (SELECT dst, 1.0 / greatest(sum(a * x), 1e-12) AS y FROM a JOIN x{k + 1} USING (src) GROUP BY dst)")
    return f"WITH {tables.REGION_SQL}, a AS (SELECT src, dst, capacity::DOUBLE AS a FROM r), " + ", ".join(steps) + " SELECT CAST(src AS INT) AS i, CAST(dst AS INT) AS j, round(a * x * y, 6) AS value FROM a JOIN x50 USING (src) JOIN y50 USING (dst)"


@query(_sinkhorn_sql())
def sinkhorn_regions(spark, sf_dir):
    m = tables.region_pairs(spark, sf_dir).select("problem_id", F.col("src").cast("int").alias("i"), F.col("dst").cast("int").alias("j"), F.col("capacity").cast("double").alias("value"))
    goals = spark.createDataFrame([], "problem_id string, i int, target double")
    return reductions.matrix_scaling(m, goals).select("i", "j", F.round("value", 6).alias("value"))


@query(f"WITH {E} SELECT problem_id, direction, count(*) AS arcs, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT problem_id, 1 AS direction, upper - flow AS capacity, cost FROM e UNION ALL SELECT problem_id, -1, flow - lower, -cost FROM e) WHERE capacity > 0 GROUP BY 1, 2")
def residual_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    f = e.select("problem_id", "edge_id", "flow")
    return graph.residual(e.drop("flow"), f).groupBy("problem_id", "direction").agg(F.count("*").alias("arcs"), F.sum("capacity").alias("capacity"), F.sum("cost").alias("cost"))


@query(f'WITH {E} SELECT "row", count(*) AS entries, CAST(sum(value) AS BIGINT) AS net FROM (SELECT src AS "row", -1 AS value FROM e UNION ALL SELECT dst, 1 FROM e) GROUP BY 1')
def incidence_lines(spark, sf_dir):
    return graph.incidence(tables.line_edges(spark, sf_dir)).groupBy("row").agg(F.count("*").alias("entries"), F.sum("value").cast("bigint").alias("net"))


@query(f"WITH {E} SELECT problem_id, node_id, count(*) AS degree FROM (SELECT problem_id, src AS node_id FROM e UNION ALL SELECT problem_id, dst FROM e) GROUP BY 1, 2")
def degree_lines(spark, sf_dir):
    return graph.degrees(tables.line_edges(spark, sf_dir))


@query(f"WITH {E} SELECT problem_id, direction, count(*) AS n FROM (SELECT problem_id, 1 AS direction FROM e UNION ALL SELECT problem_id, -1 FROM e WHERE src <> dst) GROUP BY 1, 2")
def undirected_lines(spark, sf_dir):
    return graph.undirected(tables.line_edges(spark, sf_dir)).groupBy("problem_id", "direction").agg(F.count("*").alias("n"))


def _line_nodes(e):
    return e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("demand", F.lit(0).cast("bigint"))


@query(f"WITH {E} SELECT problem_id, node_id, CAST(sum(d) AS BIGINT) AS demand FROM (SELECT problem_id, src AS node_id, lower AS d FROM e UNION ALL SELECT problem_id, dst, -lower FROM e) GROUP BY 1, 2")
def lower_bounds_removed(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    return rewrite.remove_lower_bounds(_line_nodes(e), e)[0].select("problem_id", "node_id", "demand")


@query(f"WITH {E} SELECT problem_id, node_id, CAST(sum(d) AS BIGINT) AS missing FROM (SELECT problem_id, src AS node_id, flow AS d FROM e UNION ALL SELECT problem_id, dst, -flow FROM e) GROUP BY 1, 2")
def imbalance_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    return graph.imbalance(_line_nodes(e), e.drop("flow"), e.select("problem_id", "edge_id", "flow"))


@query(f"WITH {E}, n AS (SELECT problem_id, src AS v FROM e UNION SELECT problem_id, dst FROM e) SELECT problem_id, CAST(count(*) AS BIGINT) AS edges, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM (SELECT problem_id, 2 * v AS src, 2 * v + 1 AS dst FROM n UNION ALL SELECT problem_id, 2 * src + 1, 2 * dst FROM e) GROUP BY 1")
def vertices_split(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    out = rewrite.split_vertices(_line_nodes(e).withColumn("capacity", F.lit(7)), e)[1]
    return out.groupBy("problem_id").agg(F.count("*").alias("edges"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))


@query(f"WITH {E}, c AS (SELECT problem_id, least(src % 17, dst % 17) AS u, greatest(src % 17, dst % 17) AS v, upper AS length, edge_id FROM e WHERE src % 17 <> dst % 17) SELECT problem_id, u, v, min(length) AS length, arg_min(edge_id, (length, edge_id)) AS edge_id FROM c GROUP BY 1, 2, 3")
def contracted_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir).withColumn("length", F.col("upper"))
    return graph.contract(e, _line_nodes(e).withColumn("image", F.col("node_id") % 17)).select("problem_id", "u", "v", "length", "edge_id")


@query(f"WITH {E} SELECT problem_id, src, dst, cost, min(edge_id) AS edge_id, CAST(sum(lower) AS BIGINT) AS lower, CAST(sum(upper) AS BIGINT) AS upper FROM e GROUP BY 1, 2, 3, 4")
def parallel_merged(spark, sf_dir):
    return merge_parallel(tables.line_edges(spark, sf_dir))


@query(f"WITH {E} SELECT problem_id, edge_id FROM e WHERE edge_id % 50 = 0")
def sampled_lines(spark, sf_dir):
    return graph.sample_every(tables.line_edges(spark, sf_dir), 50).select("problem_id", "edge_id")


@query(f"WITH {E}, x AS (SELECT problem_id, edge_id, src AS v FROM e UNION ALL SELECT problem_id, edge_id, dst FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY problem_id, v ORDER BY edge_id) AS k FROM x) SELECT DISTINCT problem_id, edge_id FROM k WHERE k <= 2")
def sparsified_lines(spark, sf_dir):
    return graph.sparsify(tables.line_edges(spark, sf_dir))


@query(f"WITH {E} SELECT problem_id, edge_id FROM e WHERE src % 3 = 0 AND dst % 3 = 0")
def induced_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    return graph.induced(e, _line_nodes(e).where("node_id % 3 = 0")).select("problem_id", "edge_id")


@query(
    f"""WITH {E} SELECT problem_id, count(*) AS m, max(upper) AS max_bound, max(abs(cost)) AS max_cost,
  CAST(sum(CASE WHEN cost >= 0 THEN cost * lower ELSE cost * upper END) AS BIGINT) AS cost_lower_bound, CAST(sum(abs(cost)) * max(upper) AS BIGINT) AS cost_upper_bound FROM e GROUP BY 1"""
)
def size_facts_lines(spark, sf_dir):
    return rewrite.size_facts(tables.line_edges(spark, sf_dir)).select("problem_id", "m", "max_bound", "max_cost", _long("cost_lower_bound"), _long("cost_upper_bound"))


@query("SELECT CAST(l_suppkey % 10 AS VARCHAR) AS problem_id, CAST(6 AS BIGINT) AS capacity_gcd, CAST(10 AS BIGINT) AS cost_gcd FROM lineitem GROUP BY 1")
def gcd_scaled(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir).select("problem_id", "edge_id", F.col("lower") * 0, (F.col("upper") * 6).alias("upper"), (F.col("cost") * 10).alias("cost")).toDF("problem_id", "edge_id", "lower", "upper", "cost")
    nodes = e.select("problem_id").distinct().withColumn("demand", F.lit(12).cast("bigint"))
    return rewrite.gcd_scale(nodes, e)


@query(f"WITH {E} SELECT problem_id, 'lower above upper' AS rule, count(*) AS n FROM e WHERE edge_id % 100 = 7 GROUP BY 1 UNION ALL SELECT problem_id, 'no finite capacity', count(*) FROM e WHERE edge_id % 100 = 9 GROUP BY 1 UNION ALL SELECT problem_id, 'duplicate edge', count(*) FROM (SELECT problem_id, edge_id FROM e GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def violations_found(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    nodes = _line_nodes(e)
    k = F.col("edge_id") % 100
    bad = e.withColumn("lower", F.when(k == 7, F.col("upper") + 1).otherwise(F.col("lower"))).withColumn("upper", F.when(k == 9, F.lit(None)).otherwise(F.col("upper")))
    found = problem.violations(nodes, bad)
    return found.groupBy("problem_id", "rule").agg(F.count("*").alias("n"))


FLOWED = f"WITH {E}, g AS (SELECT *, CAST(upper - flow AS DOUBLE) AS up, CAST(flow - lower AS DOUBLE) AS down FROM e)"


@query(f"{FLOWED} SELECT problem_id, round(sum(cost + 0.5 * (1 / greatest(up, 0.001) - 1 / greatest(down, 0.001))), 3) AS gradient, round(sum(abs(cost) * (abs(flow) + 1e-12)), 3) AS gap FROM g GROUP BY 1")
def gradient_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    g = numerics.gradient_proxy(F.col("cost"), F.col("flow"), F.col("lower"), F.col("upper"), 0.5, 0.001)
    return e.groupBy("problem_id").agg(F.round(F.sum(g), 3).alias("gradient"), F.round(F.sum(numerics.gap_proxy(F.col("cost").cast("double"), F.col("flow"))), 3).alias("gap"))


@query(f"{FLOWED} SELECT problem_id, round(sum(pow(greatest(up, 0.01), -1.1) + pow(greatest(down, 0.01), -1.1)), 2) AS lengths, round(sum(1.1 * (pow(greatest(up, 0.01), -2.1) - pow(greatest(down, 0.01), -2.1))), 1) AS gradient FROM g GROUP BY 1")
def barrier_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    c = [F.col(x).cast("double") for x in ("flow", "lower", "upper")]
    return e.groupBy("problem_id").agg(F.round(F.sum(numerics.barrier_lengths(*c, 1.1, 0.01)), 2).alias("lengths"), F.round(F.sum(numerics.barrier_gradient(*c, 1.1, 0.01)), 1).alias("gradient"))


@query(f"{FLOWED} SELECT problem_id, CAST(sum(flow * cost) AS BIGINT) AS total, round(sum(pow(greatest(up, 1e-12), 1.1) + pow(greatest(down, 1e-12), 1.1)), 3) AS barrier FROM g GROUP BY 1")
def potential_lines(spark, sf_dir):
    return numerics.potential(tables.line_edges(spark, sf_dir), 0.001, 1.1, -1e6).select("problem_id", _long("total"), F.round("barrier", 3).alias("barrier"))


@query(f"WITH {E} SELECT problem_id, CAST(sum(cost * flow) AS BIGINT) AS dot, CAST(sum(abs(cost)) AS BIGINT) AS l1, round(sqrt(sum(cost * cost)), 6) AS l2 FROM e GROUP BY 1")
def norms_lines(spark, sf_dir):
    return numerics.norms(tables.line_edges(spark, sf_dir), "cost", "flow").select("problem_id", _long("dot"), _long("l1"), F.round("l2", 6).alias("l2"))


@query(f"{FLOWED} SELECT problem_id, min(CASE WHEN cost > 0 THEN up / cost ELSE down / -cost END) AS step FROM g GROUP BY 1")
def longest_step_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir).withColumn("delta", F.col("cost").cast("double"))
    return numerics.longest_step(e)


@query(f"WITH {E}, t AS (SELECT problem_id, CAST(count(*) AS DOUBLE) AS m, 1000.0::DOUBLE AS total FROM e GROUP BY 1) SELECT problem_id, round(sum(sqrt(abs(cost) + total)), 3) AS p_norm_score, round(sum(exp(-0.1 * cost) / m * total), 3) AS transport_score, round(sum(1 / greatest(abs(cost), 1e-9)), 3) AS diffusion_score FROM e JOIN t USING (problem_id) GROUP BY 1")
def scores_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    nodes = e.select("problem_id").distinct().selectExpr("problem_id", "stack(2, -500L, 500L) AS demand")
    s = convex.scores(e, nodes)
    return s.groupBy("problem_id").agg(*[F.round(F.sum(c), 3).alias(c) for c in ("p_norm_score", "transport_score", "diffusion_score")])


@query(f"WITH {E} SELECT problem_id, round(sum(pow(abs(0.5 * flow), 3) / 3), 4) AS p_norm, round(sum(greatest(flow, 1e-12) * ln(greatest(flow, 1e-12)) - greatest(flow, 1e-12) + 2), 3) AS entropy FROM e GROUP BY 1")
def convex_values_lines(spark, sf_dir):
    f = F.col("flow").cast("double")
    return tables.line_edges(spark, sf_dir).groupBy("problem_id").agg(F.round(F.sum(convex.p_norm(f, F.lit(0.5), 3.0)), 4).alias("p_norm"), F.round(F.sum(convex.entropy(f, 0.5)), 3).alias("entropy"))


@query(f"WITH {E} SELECT problem_id, edge_id FROM e WHERE edge_id % 5 = 0 OR edge_id % 7 = 0")
def dirty_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir).select("problem_id", "edge_id", F.col("cost").cast("double").alias("gradient"), F.col("upper").cast("double").alias("length"))
    new = e.withColumn("gradient", F.col("gradient") + F.when(F.col("edge_id") % 5 == 0, 1.0).otherwise(0.25)).withColumn("length", F.col("length") * F.when(F.col("edge_id") % 7 == 0, 2.0).otherwise(1.125))
    return graph.dirty_edges(e, new)


@query(f"WITH {E} SELECT problem_id, count(*) AS n, CAST(sum(CASE WHEN edge_id % 11 = 0 THEN cost + 100 ELSE cost END) AS BIGINT) AS cost FROM e WHERE edge_id % 13 <> 0 GROUP BY 1")
def deltas_merged(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    up = e.where("edge_id % 11 = 0").withColumn("cost", F.col("cost") + 100).withColumn("op", F.lit("upsert")).withColumn("seq", F.lit(1))
    gone = e.where("edge_id % 13 = 0").withColumn("op", F.lit("delete")).withColumn("seq", F.lit(2))
    return deltas.merge(e, up.unionByName(gone)).groupBy("problem_id").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@query(f"WITH {E}, x AS (SELECT problem_id, CAST(floor(log2(greatest(max(abs(cost)), 1))) AS INT) AS k, CAST(floor(log2(greatest(max(upper), 1))) AS INT) AS j FROM e GROUP BY 1) SELECT problem_id, CAST(sum(round(cost / pow(2.0, k))) AS BIGINT) AS scaled_cost, CAST(sum(greatest(round(upper / pow(2.0, j)), 1)) AS BIGINT) AS scaled_upper FROM e JOIN x USING (problem_id) GROUP BY 1")
def polynomial_scaling_lines(spark, sf_dir):
    e = rewrite.polynomial_costs(tables.line_edges(spark, sf_dir)).drop("exponent")
    return rewrite.polynomial_capacities(e).groupBy("problem_id").agg(F.sum("scaled_cost").alias("scaled_cost"), F.sum("scaled_upper").alias("scaled_upper"))


@query(f"WITH {E}, b AS (SELECT *, flow AS base FROM e), d AS (SELECT problem_id, src AS node_id, base AS d FROM b UNION ALL SELECT problem_id, dst, -base FROM b) SELECT problem_id, (SELECT count(*) FROM e f WHERE f.problem_id = d.problem_id AND upper % 4 = 1) AS edges, CAST(sum(abs(m)) AS BIGINT) AS missing FROM (SELECT problem_id, node_id, sum(d) AS m FROM d GROUP BY 1, 2) d GROUP BY problem_id")
def rounding_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    flows = e.select("problem_id", "edge_id", (F.col("flow") + F.when(F.col("upper") % 4 == 1, 0.5).otherwise(0.0)).alias("flow"))
    nodes, left = rewrite.rounding_instance(_line_nodes(e), e.drop("flow"), flows)
    need = nodes.groupBy("problem_id").agg(F.sum(F.abs("demand")).alias("missing"))
    return left.groupBy("problem_id").agg(F.count("*").alias("edges")).join(need, "problem_id")


@query(f"WITH {E} SELECT problem_id, least(src, dst) AS u, greatest(src, dst) AS v, min(edge_id) AS edge_id FROM e WHERE src <> dst GROUP BY 1, 2, 3")
def undirected_pairs_lines(spark, sf_dir):
    return graph.undirected_pairs(tables.line_edges(spark, sf_dir))


@query(f"WITH {E}, x AS (SELECT problem_id, src AS node_id FROM e UNION ALL SELECT problem_id, dst FROM e), d AS (SELECT problem_id, node_id, count(*) AS degree FROM x GROUP BY 1, 2), n AS (SELECT problem_id, ceil(0.3 * ln(greatest(count(*), 2))) AS least FROM d GROUP BY 1) SELECT problem_id, node_id, degree FROM d JOIN n USING (problem_id) WHERE degree < least")
def low_degree_lines(spark, sf_dir):
    return graph.low_degree(tables.line_edges(spark, sf_dir), 0.3)


@query(f"WITH {E}, n AS (SELECT problem_id, src AS v FROM e UNION SELECT problem_id, dst FROM e) SELECT problem_id, CAST(v % 8 AS INT) AS part, count(*) AS nodes, CAST(sum(v // 2) AS BIGINT) AS images FROM n GROUP BY 1, 2")
def node_parts_lines(spark, sf_dir):
    n = _line_nodes(tables.line_edges(spark, sf_dir))
    return graph.parts(n, 8).join(graph.halved(n), ["problem_id", "node_id"]).groupBy("problem_id", "part").agg(F.count("*").alias("nodes"), F.sum("image").alias("images"))


@query(f"{PATHS} SELECT round(avg(p.d / e.w), 6) AS mean_stretch FROM e JOIN p ON p.a = e.u AND p.v = e.v")
def mean_stretch_regions(spark, sf_dir):
    nodes, e, forest = _region_tree(spark, sf_dir)
    return graph.mean_stretch(graph.stretch(graph.rooted(nodes, forest), e)).select(F.round("mean_stretch", 6).alias("mean_stretch"))


@query(f"WITH {E} SELECT problem_id, bool_and(edge_id % 3 = 0 OR upper <= 0.5 * (upper + 20)) AS stable FROM e GROUP BY 1")
def stability_lines(spark, sf_dir):
    e = tables.line_edges(spark, sf_dir)
    before = e.select("problem_id", "edge_id", (F.col("upper") + 20.0).alias("width"))
    dirty = e.where("edge_id % 3 = 0").select("problem_id", "edge_id")
    return graph.widths_stable(before, e.select("problem_id", "edge_id", F.col("upper").cast("double").alias("width")), dirty, 0.5)


from . import scaling_queries, solver_queries, tree_queries  # noqa: E402, F401  they add their own
