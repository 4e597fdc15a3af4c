"""Trees, cuts and circulations against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netloom.operators import circulation, decremental, expander, graph, spanner, trees

EDGE = "problem_id string, edge_id bigint, src bigint, dst bigint, length double, gradient double"
NODE = "problem_id string, node_id bigint"


@pytest.fixture(scope="module")
def forest(spark):
    """Two trees and a lone node, edges off the tree, and each node's parent, edge, way, root, depth and prefix by depth-first search."""
    rnd, n = random.Random(3), 60
    ends = [(v, rnd.randrange(max(0, v - 4), v)) for v in range(1, 40)] + [(rnd.randrange(40, v), v) for v in range(41, n)]
    tree = [("p", i, a, b, float(rnd.randint(1, 9)), float(rnd.randint(-5, 5))) for i, (a, b) in enumerate(ends)]
    off = [("p", 1000 + i, a, b, float(rnd.randint(1, 9)), float(rnd.randint(-5, 5))) for i in range(40) if (a := rnd.randrange(40)) != (b := rnd.randrange(40))]
    near = {v: [] for v in range(n + 1)}
    for _, i, a, b, w, _ in tree:
        near[a].append((b, i, w, 1))
        near[b].append((a, i, w, -1))
    known = {}
    for root in (0, 40, 60):
        stack = [(root, (None, None, None, root, 0, 0.0))]
        while stack:
            v, facts = stack.pop()
            known[v] = facts
            stack += [(to, (v, i, way, root, facts[4] + 1, facts[5] + w)) for to, i, w, way in near[v] if to != facts[0]]
    nodes = spark.createDataFrame([("p", v) for v in known], NODE)
    return nodes, spark.createDataFrame(tree, EDGE), spark.createDataFrame(tree + off, EDGE), known


@pytest.fixture(scope="module")
def tour(forest):
    return trees.euler_tour(forest[1], forest[0])


def test_tour_roots_and_intervals(forest, tour):
    known, rows = forest[3], {r.node_id: r for r in tour.collect()}
    assert {v: (r.parent, r.parent_edge, r.direction, r.root, r.depth, r.prefix_length) for v, r in rows.items()} == known
    for v in known:
        above = lambda w: w == v or known[w][0] is not None and above(known[w][0])  # noqa: B023, E731
        assert {w for w in known if known[w][3] == known[v][3] and rows[v].first <= rows[w].first <= rows[v].last} == {w for w in known if above(w)}


def test_hub_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(trees, "ARCS_AT_ONCE", 7)
    e = spark.createDataFrame([("s", i, 0, i, 1.0, 0.0) for i in range(1, 50)] + [("s", 50, 49, 50, 1.0, 0.0)], EDGE)
    rows = trees.euler_tour(e, e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id"))).collect()
    assert {r.node_id: r.parent for r in rows} == {0: None, 50: 49} | {i: 0 for i in range(1, 50)}
    assert len({r.first for r in rows}) == 51


@pytest.mark.parametrize("k", [0, 6, 25, 58])
def test_cuts_against_walks_up(spark, forest, tour, k):
    known = forest[3]
    cuts = set(random.Random(k).sample([f[1] for f in known.values() if f[1] is not None], min(k, 57)))
    got = {r.node_id: r.top for r in trees.after_cuts(tour, spark.createDataFrame([("p", c) for c in cuts], "problem_id string, edge_id bigint"), width=7).collect()}

    def top(v):
        while known[v][0] is not None and known[v][1] not in cuts:
            v = known[v][0]
        return v

    assert got == {v: top(v) for v in known}


def test_sums_equal_paths(forest, tour):
    nodes, tree, every, _ = forest
    p = trees.paths(trees.with_values(tour, every))
    rooted = graph.rooted(nodes, tree)
    want = graph.cycle_scores(graph.cycles(rooted, every), every).select("problem_id", "edge_id", "gradient", "length", "ratio")
    assert sorted(trees.cycle_scores(every, tour, p).collect()) == sorted(want.collect())
    best = graph.best_cycle(trees.cycle_scores(every, tour, p)).collect()
    assert best == graph.best_cycle(want).collect()
    want = sorted((r.edge_id, r.path_length, r.stretch) for r in graph.stretch(rooted, every).collect())
    assert sorted((r.edge_id, r.path_length, r.stretch) for r in trees.path_sums(every, p).collect()) == want


def test_deep_tree(spark):
    """100,000 nodes, the deepest at 10,000: rows of ancestors stay within n log2(depth)."""
    n, deep = 100_000, 10_000
    t = spark.range(n).select(F.lit("d").alias("problem_id"), F.col("id").alias("node_id"), F.when(F.col("id") == 0, None).when(F.col("id") <= deep, F.col("id") - 1).otherwise(F.col("id") % deep).alias("parent"), F.lit(2.0).alias("length"), F.lit(-1.0).alias("gradient"))
    p = trees.paths(t)
    assert len(p.ups) == 14 and sum(u.count() for u in p.ups) <= n * 14
    depth = F.when(F.col("node_id") <= deep, F.col("node_id")).otherwise(F.col("node_id") % deep + 1)
    assert p.to_root.where((F.col("depth") != depth) | (F.col("length") != 2 * depth) | (F.col("gradient") != -depth) | (F.col("root") != 0)).count() == 0
    e = spark.createDataFrame([("d", 1, 5, 9999, 4.0, 0.0), ("d", 2, 55_000, 75_001, 1.0, 0.0), ("d", 3, 7, 7, 1.0, 0.0)], EDGE)
    assert [(r.edge_id, r.lca, r.path_length) for r in sorted(trees.path_sums(e, p).collect(), key=lambda r: r.edge_id)] == [(1, 5, 19988.0), (2, 5000, 2.0 * (1 + 2)), (3, 7, 0.0)]


def test_low_diameter_against_all_distances(spark):
    rnd = random.Random(5)
    e = [("p", i, rnd.randrange(25), rnd.randrange(25), float(rnd.randint(1, 9)), 0.0) for i in range(60)]
    shift = {v: rnd.randint(0, 12) for v in range(26)}
    far = {a: {b: 0 if a == b else 10**9 for b in shift} for a in shift}
    for _, _, a, b, w, _ in e:
        far[a][b] = far[b][a] = min(far[a][b], int(w)) if a != b else 0
    for k in shift:
        for a in shift:
            for b in shift:
                far[a][b] = min(far[a][b], far[a][k] + far[k][b])
    nodes = spark.createDataFrame([("p", v, s) for v, s in shift.items()], NODE + ", shift bigint")
    rows = {r.node_id: r for r in trees.low_diameter(nodes, spark.createDataFrame(e, EDGE)).collect()}
    for v, r in rows.items():
        assert (r.distance - shift[r.center], r.center) == min((far[u][v] - shift[u], u) for u in shift)
        assert (r.parent is None) == (r.center == v)
        if r.parent is not None:
            _, _, a, b, w, _ = e[r.parent_edge]
            assert {a, b} == {v, r.parent} and rows[r.parent].center == r.center and rows[r.parent].distance + w == r.distance


def test_low_stretch_spans(spark):
    rnd = random.Random(2)
    e = spark.createDataFrame([("a", i, rnd.randrange(20), rnd.randrange(20), rnd.uniform(0.5, 40), 0.0) for i in range(50)] + [("b", 100, 1, 2, 3.0, 0.0)], EDGE)
    nodes = e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    chosen = e.join(trees.low_stretch(nodes, e), ["problem_id", "edge_id"], "left_semi")
    parts = sorted(graph.connected(nodes, e).collect())
    assert sorted(graph.connected(nodes, chosen).collect()) == parts
    assert chosen.count() == nodes.count() - len({(r.problem_id, r.component) for r in parts})
    assert trees.low_stretch(nodes, e.where("false")).count() == 0


def test_low_stretch_beats_the_minimum_forest(spark):
    """A ring of heavier spokes: the minimum forest goes round the ring, a low-stretch tree over the hub."""
    n = 40
    e = spark.createDataFrame([("w", i, i, (i + 1) % n, 1.0 + i * 1e-3, 0.0) for i in range(n)] + [("w", n + i, i, n, 1.1, 0.0) for i in range(n)], EDGE)
    nodes = e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()

    def mean(tree):
        t = trees.breadth_first(e.join(tree, ["problem_id", "edge_id"], "left_semi"), spark.createDataFrame([("w", 0)], NODE))
        return trees.path_sums(e, trees.paths(trees.with_values(t, e))).agg(F.avg("stretch")).first()[0]

    assert mean(trees.low_stretch(nodes, e)) < 0.5 * mean(graph.spanning_forest(nodes, e).select("problem_id", "edge_id"))


def test_embedding_joins_ends(spark):
    rnd = random.Random(9)
    rows = [("p", i, rnd.randrange(30), rnd.randrange(30), 1.0, 0.0) for i in range(150)]
    e = spark.createDataFrame(rows, EDGE)
    found = spanner.clusters(e, spark.createDataFrame([("p", v) for v in (0, 7, 14)], NODE))
    kept = {r.edge_id for r in spanner.cluster_spanner(e, found).collect()}
    steps = {}
    for r in sorted(spanner.embedding(e, found).collect(), key=lambda r: (r.edge_id, r.k)):
        steps.setdefault(r.edge_id, []).append((r.step_edge, r.step_direction))
    ends = {i: (a, b) for _, i, a, b, _, _ in rows}
    assert set(steps) == {i for i, (a, b) in ends.items() if a != b}
    for i, path in steps.items():
        at = ends[i][0]
        for edge, way in path:
            a, b = ends[edge][::way]
            assert a == at and edge in kept
            at = b
        assert at == ends[i][1] and len(path) <= 3


def test_walks_are_closed_and_sum_up(spark):
    rnd, flow = random.Random(4), Counter()
    for _ in range(30):  # sums of circles are circulations
        nodes, units = rnd.sample(range(12), rnd.randint(2, 6)), rnd.randint(1, 3)
        for a, b in zip(nodes, nodes[1:] + nodes[:1]):
            flow[a, b] += units
    rows = [("p", i, a, b, f) for i, ((a, b), f) in enumerate(flow.items())] + [("p", 999, 1, 2, 0)]
    e = spark.createDataFrame(rows, "problem_id string, edge_id bigint, src bigint, dst bigint, flow bigint")
    walks, sums = {}, Counter()
    for r in circulation.closed_walks(e).collect():
        walks.setdefault(r.walk, []).append(r.edge_id)
        sums[r.edge_id] += 1
    assert sums == {i: f for _, i, _, _, f in rows if f}
    for edges in walks.values():
        balance = Counter()
        for i in edges:
            balance[rows[i][2]] -= 1
            balance[rows[i][3]] += 1
        assert not any(balance.values())
    with pytest.raises(Exception, match="isn't balanced"):
        circulation.closed_walks(e.where("edge_id <> 0")).collect()


def test_levels_equal_fresh_search_after_each_batch(spark):
    rnd = random.Random(11)
    rows = {i: (rnd.randrange(40), rnd.randrange(40)) for i in range(110)}
    make = lambda r: spark.createDataFrame([("p", i, a, b) for i, (a, b) in r.items()], "problem_id string, edge_id bigint, src bigint, dst bigint")
    now = decremental.levels(make(rows), spark.createDataFrame([("p", 0)], NODE))
    for size in (1, 8, 40, 0):
        gone = rnd.sample(sorted(rows), size)
        rows = {i: e for i, e in rows.items() if i not in gone}
        now = decremental.deletions(now, spark.createDataFrame([("p", i) for i in [*gone, 5555]], "problem_id string, edge_id bigint"))
        near = {v: {b for a, b in rows.values() if a == v} | {a for a, b in rows.values() if b == v} for v in range(40)}
        level, front = {0: 0}, [0]
        while front:
            front = [w for w in {w for v in front for w in near[v]} if w not in level]
            level |= {w: max(level.values()) + 1 for w in front}
        got = {r.node_id: r for r in now.tree.collect()}
        assert {v: r.depth for v, r in got.items()} == level
        for v, r in got.items():
            if v:
                assert set(rows[r.parent_edge]) == {v, r.parent} and got[r.parent].depth == r.depth - 1
        assert size or now.touched == 0
    assert now.edges.count() == len(rows)


def test_weights_follow_the_formula(spark):
    import math

    rows = [("p", i, a, b, w, float(i % 3)) for i, (a, b, w) in enumerate([(0, 1, 1.0), (1, 2, 1.1), (2, 3, 1.2), (3, 0, 1.3), (0, 2, 2.0), (3, 4, 1.0), (4, 0, 1.9)])]
    e = spark.createDataFrame(rows, "problem_id string, edge_id bigint, src bigint, dst bigint, length double, circulation double")
    nodes = spark.createDataFrame([("p", v) for v in range(5)], NODE)
    tree, weight = trees.weighted_trees(nodes, e, rounds=3, eta=0.4)
    trees_of, after = {}, {}
    for r in tree.collect():
        trees_of.setdefault(r.round, set()).add(r.edge_id)
    for r in weight.collect():
        after[r.round, r.edge_id] = r
    w = dict.fromkeys(range(7), 1.0)
    for k in range(3):
        group, chosen = list(range(5)), set()
        for i in sorted(w, key=lambda i: (rows[i][4] / w[i], i)):
            a, b = group[rows[i][2]], group[rows[i][3]]
            if a != b:
                group, chosen = [a if g == b else g for g in group], chosen | {i}
        assert trees_of[k] == chosen
        far = {(a, b): 0.0 if a == b else math.inf for a in range(5) for b in range(5)}
        for i in chosen:
            far[rows[i][2], rows[i][3]] = far[rows[i][3], rows[i][2]] = rows[i][4]
        for m in range(5):
            for a in range(5):
                for b in range(5):
                    far[a, b] = min(far[a, b], far[a, m] + far[m, b])
        for i in w:
            stretch = far[rows[i][2], rows[i][3]] / rows[i][4]
            w[i] *= math.exp(0.4 * stretch) if rows[i][5] else 1.0
            assert math.isclose(after[k, i].stretch, stretch) and math.isclose(after[k, i].weight, w[i])


def test_minimum_forest_against_kruskal(spark):
    rnd = random.Random(12)
    rows = [(p, i, rnd.randrange(30), rnd.randrange(30), float(rnd.randint(1, 6))) for i, p in enumerate("ab" * 60)]
    e = spark.createDataFrame(rows, "problem_id string, edge_id bigint, src bigint, dst bigint, length double")
    nodes = e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    want, group = set(), {(p, v): v for p in "ab" for v in range(30)}
    for p, i, a, b, _ in sorted(rows, key=lambda r: (r[4], r[1])):
        x, y = group[p, a], group[p, b]
        if x != y:
            group = {k: x if k[0] == p and g == y else g for k, g in group.items()}
            want.add((p, i))
    got = [(r.problem_id, r.edge_id) for r in graph.spanning_forest(nodes, e).collect()]
    assert sorted(got) == sorted(want)
    assert graph.spanning_forest(nodes, e.where("false")).count() == 0


def test_parts_are_cut_at_bottlenecks(spark):
    """Three cliques in a row, joined by single edges, beside one clique of a problem of its own: the parts are the cliques, and the cut edges
    and each cut's conductance are as counted by hand."""
    rows, k = [], 0
    for c in range(3):
        for a in range(8):
            for b in range(a):
                rows.append(("row", (k := k + 1), 10 * c + a, 10 * c + b))
    rows += [("row", 900, 0, 10), ("row", 901, 11, 20)] + [("one", 2000 + 10 * a + b, a, b) for a in range(7) for b in range(a)]
    e = spark.createDataFrame(rows, "problem_id string, edge_id bigint, src bigint, dst bigint").withColumn("x", F.lit("clash"))
    nodes = e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).union(spark.createDataFrame([("row", 77)], NODE))
    part, between = expander.decompose(nodes, e, least=0.1, rounds=24)
    groups = {}
    for r in part.collect():
        groups.setdefault((r.problem_id, r.part), set()).add(r.node_id)
    cliques = sorted([sorted(range(10 * c, 10 * c + 8)) for c in range(3)])
    assert sorted(sorted(v - {77}) for (p, _), v in groups.items() if p == "row" and v != {77}) == cliques
    assert [sorted(v) for (p, _), v in groups.items() if p == "one"] == [list(range(7))]
    assert sorted(r.edge_id for r in between.collect()) == [900, 901]
    at, cuts = expander.sweep(expander.walked(e, 24), e)
    side = {(r.problem_id, r.node_id): r.bin for r in at.collect()}
    for c in cuts.collect():
        own = [(a, b) for p, _, a, b in rows if p == c.problem_id]
        low = lambda v: side[c.problem_id, v] <= c.bin  # noqa: B023, E731
        volume = [sum(low(v) == s for ab in own for v in ab) for s in (True, False)]
        assert c.cut == sum(low(a) != low(b) for a, b in own) and c.volume == min(volume) and c.conductance == c.cut / c.volume


def test_contraction_writes_in_proportion_to_the_rows(spark, monkeypatch):
    """Over a chain, doubling would write every row a round; contraction writes a few times the rows and gives the same sums."""
    n = 2000
    tree = spark.range(n).selectExpr("'p' AS problem_id", "id AS node_id", "nullif(id, 0) - 1 AS parent", "CAST(id % 5 AS DOUBLE) AS length", "0D AS gradient").coalesce(2)
    monkeypatch.setattr(trees, "FEW", 64)
    counts, plain = [], trees.written

    def counted(df, label):
        out = plain(df, label)
        counts.append(out.count())
        return out

    monkeypatch.setattr(trees, "written", counted)
    got = {r.node_id: (r.root, r.depth, r.length) for r in trees.root_sums(tree).collect()}
    assert sum(counts) < 8 * n
    far = 0.0
    for v in range(n):
        far += v % 5 if v else 0
        assert got[v] == (0, v, far)


def test_tour_by_contraction_equals_doubling(spark, forest, tour, monkeypatch):
    monkeypatch.setattr(trees, "FEW", 12)
    tree, nodes = forest[1], forest[0]
    again = trees.euler_tour(tree, nodes)
    assert sorted(map(tuple, again.select(*tour.columns).collect()), key=repr) == sorted(map(tuple, tour.collect()), key=repr)


def test_no_join_by_the_common_ancestor(forest, tour):
    """Most pairs can share one ancestor, so a join by it is a join of all pairs in one task."""
    p = trees.paths(trees.with_values(tour, forest[1]))
    plan = trees.path_sums(forest[2], p)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "lca#" in line]


def test_rows_of_one_label_stay_where_they_are(spark, monkeypatch):
    """Labels of over HOT rows are broadcast, others joined; both give the least node of each component."""
    e = spark.createDataFrame([("p", i, 0, i) for i in range(1, 60)] + [("p", 100 + i, i, i + 1) for i in range(100, 110)] + [("q", i, 5, 5 + i) for i in range(1, 9)], "problem_id string, edge_id bigint, src bigint, dst bigint")
    nodes = e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    monkeypatch.setattr(graph, "HOT", 7)
    seen, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: (seen.append((label, out := plain(df, label))), out)[1])
    got = {tuple(r) for r in graph.connected(nodes, e).select("problem_id", "node_id", "component").collect()}
    assert got == {("p", v, 0 if v < 60 else 100) for v in [*range(60), *range(100, 111)]} | {("q", 5 + i, 5) for i in range(9)}
    hot = [out for label, out in seen if label == "hot-labels"]
    assert {tuple(r)[:2] for r in hot[-1].select("problem_id", "next").collect()} == {("p", 0), ("p", 100), ("q", 5)}


def _sent(spark, run) -> int:
    """Rows that the stages of a run have shuffled, without broadcasts, as at large sizes."""
    sc = spark.sparkContext
    seen = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    count = lambda: sum(s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(seen()))
    before = count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return count() - before


def _dense(spark):
    """Every one of 60 nodes joined with every one of 60 others: 7,200 arcs, few nodes."""
    rows = [("p", 100 * a + b, a, 1000 + b, 1.0 + (7 * a + 3 * b) % 5, 0.0) for a in range(60) for b in range(60)]
    return spark.createDataFrame(rows, EDGE)


def test_steps_of_a_walk_send_no_arcs(spark):
    e = _dense(spark)
    few, many = (_sent(spark, lambda: expander.walked(e, n).collect()) for n in (1, 4))  # noqa: B023
    assert (many - few) / 3 < 7200 / 2


def test_a_walk_of_many_parallel_edges_is_exact(spark):
    e = spark.createDataFrame([("p", 0, 1)], "problem_id string, src bigint, dst bigint").crossJoin(spark.range(20_000)).union(spark.createDataFrame([("p", 1, 2, 0)], "problem_id string, src bigint, dst bigint, id bigint"))
    x = {r.node_id: r.x for r in spark.range(3).select(F.col("id").alias("node_id"), expander.start_value(F.col("id")).alias("x")).collect()}
    w, degree = {(0, 1): 20_000, (1, 0): 20_000, (1, 2): 1, (2, 1): 1}, {0: 20_000, 1: 20_001, 2: 1}
    for _ in range(3):
        total = {v: x[v] * degree[v] + sum(n * x[b] for (a, b), n in w.items() if a == v) for v in x}
        x = {v: (abs(s) // (2 * degree[v])) * (1 if s > 0 else -1) for v, s in total.items()}
    assert {r.node_id: (r.degree, r.x) for r in expander.walked(e, 3).collect()} == {v: (degree[v], x[v]) for v in x}


def test_rounds_of_clusters_send_no_arcs(spark):
    e = _dense(spark)
    nodes = e.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("shift", F.lit(0).cast("bigint"))
    # A long tail makes rounds in which only it grows.
    tail = spark.createDataFrame([("p", 10**6 + i, 1059 + i, 1060 + i, 1.0, 0.0) for i in range(12)], EDGE)
    more = spark.createDataFrame([("p", 1060 + i, 0) for i in range(12)], "problem_id string, node_id bigint, shift bigint")
    shifted = nodes.unionByName(more).withColumn("shift", F.when(F.col("node_id") == 0, 100).otherwise(0).cast("bigint"))
    assert _sent(spark, lambda: trees.low_diameter(shifted, e.unionByName(tail)).select("center").collect()) < 7200 * 8


def test_levels_after_deletions_send_arcs_once(spark):
    e = _dense(spark)
    path = spark.createDataFrame([("p", 10**6 + i, 2000 + i if i else 0, 2001 + i, 1.0, 0.0) for i in range(6)], EDGE)
    e = e.unionByName(path)
    now = decremental.levels(e, spark.createDataFrame([("p", 0)], NODE))
    gone = spark.createDataFrame([("p", 10**6)], "problem_id string, edge_id bigint")
    assert _sent(spark, lambda: decremental.deletions(now, gone)) < 7200 * 4


def test_embedding_over_a_known_spanner(spark):
    """The same paths whether the spanner is given or found again."""
    e = _dense(spark)
    found = spanner.clusters(e, spark.createDataFrame([("p", v) for v in (0, 7, 1014)], NODE))
    kept = spanner.cluster_spanner(e, found)
    given, own = (sorted(map(tuple, spanner.embedding(e, found, *k).collect())) for k in ((kept,), ()))
    assert given == own and {r[1] for r in own} == {r.edge_id for r in e.collect()}
    assert {r[3] for r in own} <= {r.edge_id for r in kept.collect()}


def test_the_way_up_takes_few_columns(forest, tour, monkeypatch):
    """Each join on the way up shuffles all that its rows hold, so these hold sums of both ends, not what is known of each."""
    seen, write = [], trees.written
    monkeypatch.setattr(trees, "JOINS_AT_ONCE", 2)
    monkeypatch.setattr(trees, "written", lambda df, label: (seen.append(df.columns) if label == "rising" else None, write(df, label))[1])
    trees.path_sums(forest[2], trees.paths(trees.with_values(tour, forest[1])))
    assert seen and all(len(columns) <= 8 for columns in seen)
