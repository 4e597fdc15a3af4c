import random

import duckdb
import pytest

from netloom.llm import common, jaccard

SF = "/root/testdata/sf0.001"


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and (root(i) not in low or d < low[root(i)]):
            low[root(i)] = d
    return sorted(((d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(1, None), (2, ""), (3, "one two three"), (4, "One TWO three"), (5, "one two"), (6, " \t\n"), (None, "one two three")]
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    shared = [f"s{i}" for i in range(40)]
    i = 10
    for edits in [0] * 10 + [1] * 20 + [2] * 20 + [4] * 20 + [6] * 15:  # around the threshold
        out.append((i, near(rng, base, edits)))
        i += 1
    for _ in range(40):  # a passage that many otherwise different documents share
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
        out.append((i, " ".join(own[:3] + shared + own[3:])))
        i += 1
    out += [(i, "x " * 30_000), (i + 1, "x " * 30_001), (i + 1, "x " * 30_001)]
    return out


@pytest.mark.parametrize("rounds", [1, 2])
def test_against_brute_force(spark, rows, rounds):
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, sid int")
    got = sorted((tuple(r) for r in jaccard.Join(docs, rounds=rounds).classes().collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard.Join(spark.createDataFrame([], "doc_id long, text string")).classes().count() == 0


def test_sql_and_brute_force_on_documents(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(jaccard.JACCARD_SQL).fetchall(), key=str)
    assert want == brute(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted((tuple(r) for r in jaccard.op6_jaccard(spark, SF).collect()), key=str) == want
    assert common.SIMILARITY * 100 == jaccard.PERCENT
