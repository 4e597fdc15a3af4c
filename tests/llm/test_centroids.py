import hashlib

import duckdb
import numpy as np
import pytest

from netloom.llm import centroids


def brute(rows, k=8, rounds=10, dimensions=64):
    """Lloyd's rounds over Python integers."""
    import math

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), a in zip(kept, at) if a == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr), c


def rows_of(seed, n, dimensions=64, clumps=5):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(clumps, dimensions))
    vectors = [(int(i), (middles[i % clumps] + 0.1 * r.normal(size=dimensions)).astype(np.float32).tolist()) for i in range(n)]
    odd = [(900, None), (901, [0.5] * 63), (902, [float("nan")] * 64), (903, [None] + [0.5] * 63), (904, [float("inf")] + [0.0] * 63), (905, []), (None, [0.25] * 64), (7, vectors[7][1]), (7, vectors[7][1])]
    return vectors + odd


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("segment,bits", [(8, 3), (5, 6), (64, 0)])
def test_equal_to_brute_force(spark, segment, bits):
    rows = rows_of(1, 120)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS v", "2 AS norms")
    found = centroids.cluster(centroids.integers(df), rounds=4, segment=segment, bits=bits)
    want, c = brute([(r.vec_id, r.embedding) for r in df.collect()], rounds=4)
    assert sorted(map(tuple, found.assigned.select("vec_id", "cluster", "distance").collect()), key=repr) == want
    assert found.centroids.tolist() == c
    assert found.exact <= found.pairs


def test_bounds_hold_and_prune():
    r = np.random.default_rng(3)
    v = np.floor(1024 * r.normal(size=(400, 64))).astype(np.int64)
    c = v[:8] + 5
    low = centroids.bounds(*centroids.compress(v), c)
    exact = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (low <= exact).all()
    at, best, taken = centroids.nearest(v, low, c)
    assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert taken < 0.3 * exact.size


def test_ties_go_to_the_smaller_number():
    v = np.array([[0, 0], [4, 0]])
    c = np.array([[4, 0], [0, 4], [4, 0]])
    at, best, _ = centroids.nearest(v, centroids.bounds(*centroids.compress(v), c), c)
    assert at.tolist() == [0, 0] and best.tolist() == [16, 0]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame(rows_of(2, 20)[:3], SCHEMA)
    found = centroids.cluster(centroids.integers(few))
    assert len(found.centroids) == 3 and {r.distance for r in found.assigned.collect()} == {0}
    assert centroids.cluster(centroids.integers(spark.createDataFrame([(1, None)], SCHEMA))).assigned.count() == 0


def test_too_large_a_component(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(centroids.integers(df))


def test_query_against_sql(spark):
    got = centroids.op12_centroids(spark, "/root/testdata/sf0.001")
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    cur = c.execute(centroids.CENTROIDS_SQL)
    assert sorted(got.columns) == sorted(d[0] for d in cur.description)
    assert sorted(map(tuple, got.select(*[d[0] for d in cur.description]).collect())) == sorted(cur.fetchall())
