import hashlib

import numpy as np

from netloom.llm import common, fingerprints as fp

SF = "/root/testdata/sf0.001"


def check(rows, out):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n, r = t or "", n or "", got[i]
        e = fp.edited(t, n)
        cut = len(t) // 3
        assert e == t[: len(t) - cut] + n[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (set(common.shingle_set(x).tolist()) for x in (t, e, n))
        assert fp.decode(r.fingerprint).tolist() == sorted(a)[: fp.K] and fp.decode(r.edited_fingerprint).tolist() == sorted(b)[: fp.K]
        for value, x in ((r.near_edited, b), (r.near_next, c)):
            true = len(a & x) / len(a | x) if a | x else 1.0
            assert abs(value - true) < (0.15 if len(a | x) > fp.K else 1e-9)


def test_edge_rows(spark):
    rows = [(5, "a b c d e f g é𝒳 h"), (4, None), (3, ""), (2, "w" + " x y z" * 30_000), (1, "a b"), (None, "Zz Yy xx ww vv uu")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, near_next double")
    check(rows, fp.fingerprints(docs).collect())
    check(rows, fp.fingerprints(docs, range_chars=20_000).collect())
    check(rows[:1], fp.fingerprints(docs.where("doc_id = 5")).collect())
    assert fp.fingerprints(docs.limit(0)).count() == 0
    check(rows[-1:], fp.fingerprints(docs.where("doc_id IS NULL")).collect())
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f")], "doc_id long, text string")
    assert fp.fingerprints(twice).count() == 3


def test_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, fp.op5_fingerprints(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(rows, fp.fingerprints(docs, range_chars=30_000).collect())


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = np.unique(rng.integers(0, 1 << 63, 9000).astype(np.uint64) * np.uint64(2)), None
    b = np.unique(np.concatenate([a[:3000], common.mix64(np.arange(6000, dtype=np.uint64))]))
    x, y = a[: fp.K], b[: fp.K]
    assert (fp.merge(a[:4000][: fp.K], a[4000:][: fp.K]) == x).all()
    u = common.mix64(np.arange(9000, dtype=np.uint64))
    v = common.mix64(np.arange(4500, 13500, dtype=np.uint64))
    x, y = np.sort(u)[: fp.K], np.sort(v)[: fp.K]
    assert abs(fp.resemblance(x, y) - 1 / 3) < 0.1 and abs(fp.distinct(x) - 9000) < 2000 and abs(fp.containment(x, y) - 0.5) < 0.15


def test_hashes_match_a_plain_loop():
    text = "The  quick\tbrown Fox\njumps over É the lazy dog " * 3
    words = [w for w in text.translate({c: c + 32 for c in range(65, 91)}).split()]
    h, s, e = common.words_of(common.lowered(text))
    assert len(h) == len(words) and len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))
    n = len(common.shingles_of(h))
    assert n == len(words) - 4
    grams = [tuple(words[i : i + 5]) for i in range(n)]
    assert len(set(zip(grams, common.shingles_of(h).tolist()))) == len(set(grams)) == len(set(common.shingles_of(h).tolist()))
