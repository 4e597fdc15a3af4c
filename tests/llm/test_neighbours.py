import math

import numpy as np

from netloom.llm import neighbours as nn

SF = "/root/testdata/sf0.01"


def brute(rows, k, asks):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, u in good:
        if asks(q):
            near = sorted((-float(u @ w / np.linalg.norm(u) / np.linalg.norm(w)), i) for i, w in good if i != q and len(w) == len(u))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_edge_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.5]) for i in range(60)]  # copies: ties go to smaller ids
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] + [1.0] * 5), (204, [float("inf")] * 6), (None, [1.0] * 6), (205, []), (210, [1.0, 2.0]), (211, [2.0, 1.0]), (220, [3.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int")
    got = {}
    for r in nn.nearest(df, lambda i: i % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, 5, lambda i: i % 10 == 0)
    for q, near in want.items():
        mine = [got[q][r] for r in sorted(got[q])] if near else []
        assert [r for r in sorted(got.get(q, {}))] == list(range(1, len(near) + 1))
        if q >= 100:
            assert [i for i, _ in mine] == [i for i, _ in near], q
    hits = sum(len({i for i, _ in near} & {got[q][r][0] for r in got[q]}) for q, near in want.items() if near)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert nn.nearest(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 5, lambda i: i % 50 == 0)
    out = nn.op8_neighbours(spark, SF).collect()
    assert len(out) == sum(map(len, want.values()))
    of = dict(rows)
    for r in out:
        a, b = np.array(of[r.query_id], float), np.array(of[r.vec_id], float)
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in out)
    assert hits / len(out) >= 0.95


def test_large_block_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32)) + 3 * rng.normal(size=(10, 32))[rng.integers(10, size=6000)]
    ids = np.arange(6000)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, got, _ in nn.search(ids, x, ids[:60], x[:60], 5):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(got.tolist()))
    assert hits / 300 > 0.95


def test_chi_square():
    assert abs(nn.chi_square(nn._limit(0.95)) - 0.95) < 1e-9 and abs(nn._limit(0.95) - 15.5073) < 1e-3
