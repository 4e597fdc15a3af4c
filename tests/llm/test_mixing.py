import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from netloom.llm import mixing


def test_targets_stop_at_twice_the_size():
    got = mixing.targets([100, 1000, 10, 0])
    assert got[0] == 200 and got[2] == 20 and got[3] == 0
    assert abs(sum(got) - 1.5 * 1110) < 1e-9
    assert mixing.targets([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5))
    assert sorted(got) == list(range(n))


def test_draw_reaches_the_slots():
    got = mixing.draw([1000, 10, 0, 300], 7)
    assert got.sum(0).tolist() == [1000, 10, 0, 300]
    assert got.min() >= 0


def check(rows, out, block):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, words):
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order])))
    of = defaultdict(list)
    for (i, t, s), n in zip(rows, words):
        of[i, n].append(s)
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), n) for (i, _, _), n in zip(rows, words))
    took = Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        s = of[r.doc_id, r.size]
        assert any(r.source_size == sizes[x] and abs(r.target - goal[x]) < 1e-6 for x in s)
        took[s[0]] += r.taken
    for s in order:
        assert abs(took[s] - goal[s]) <= 2 * block, s


def test_edge_rows(spark):
    rows = [(1, "a b c " * 500, "b"), (1, "a b c " * 500, "b"), (2, None, None), (3, "", "a"), (4, "x " * 3000, None), (None, "y z w", "a"), (6, " \t\n", "c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.Mix(docs, ["doc_id"]).taken().withColumnRenamed("keep_doc_id", "doc_id").collect()
    check(rows, out, mixing.BLOCK)


def test_empty_table(spark):
    assert mixing.Mix(spark.createDataFrame([], "doc_id long, text string, source string"), ["doc_id"]).taken().count() == 0


def test_whole_documents_and_rerun(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = mixing.op1_mixing(spark, d).collect()
    check(rows, out, mixing.BLOCK)
    assert sorted(out) == sorted(mixing.op1_mixing(spark, d).collect())


def test_slots_join_blocks_by_index(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    mix = mixing.Mix(docs, ["doc_id"], block=16, shards=4)
    placed = mix.placed().collect()
    assert {r.shard for r in placed} == {0, 1, 2, 3}
    assert all(0 < r.end_word - r.first_word <= 16 for r in placed)
    assert len({(r.src, r.idx, r.epoch) for r in placed}) == mix.slots.count()


def test_mixed_documents(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(3 + 40 * (i % 9))), "abc"[i % 3], 7) for i in range(120)] + [(500, None, "a", 0), (501, "", None, 0), (7, "same  text", "b", 9), (7, "same  text", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mix = mixing.Mix(docs, ["doc_id"], block=16, shards=4)
    took = Counter()
    for r in mix.taken().collect():
        took[r.keep_doc_id] += r.taken
    out = mixing.mixed_documents(docs, block=16, shards=4)
    assert out.columns == docs.columns
    got = Counter()
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        assert any(set(r.text.split()) <= set((t or "").split()) for t in texts[r.doc_id])
    assert got == +took


def test_equal_id_and_text_keep_their_own_rows(spark):
    """Rows that differ in source or in a further column alone each come back as themselves."""
    text = "one two three four"
    rows = [(None, text, "a", 4, "x"), (None, text, "b", 4, "x"), (None, text, "a", 4, "y"), (3, text, None, 4, "x"), (3, text, "a", 4, "x"), (3, text, "a", 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, tie string")
    mix = mixing.Mix(docs, ["doc_id"], block=4, shards=2)
    took = Counter()
    for r in mix.taken().collect():
        took[r.source] += r.taken
    got, seen = Counter(), set()
    for r in mixing.mixed_documents(docs, block=4, shards=2).collect():
        got[r.source] += len(r.text.split())
        seen.add((r.doc_id, r.source, r.tie))
    assert got == +took
    assert seen <= {(r[0], r[2], r[4]) for r in rows} and {s for _, s, _ in seen} == {s for s, n in took.items() if n}
