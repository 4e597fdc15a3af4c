import importlib

import corpus_pipeline as cp
from netloom.llm import common, jaccard, packing

from .test_jaccard import brute
from .test_packing import check
from .test_secrets import brute as brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = common.table(spark, SF, "documents")
    names = docs.columns
    kept = common.materialize(cp.known_language(spark, docs, SF), "t1")
    assert kept.columns == names and kept.count() >= 0.95 * docs.count()
    assert kept.where("lang = 'und'").count() == 0

    one = common.materialize(cp.one_of_each(spark, kept, SF), "t2")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert one.columns == names and sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, c in brute(rows) if d == c)

    clean = common.materialize(cp.without_secrets(spark, one, SF), "t3")
    assert clean.columns == names and clean.count() == one.count()
    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        spans = brute_secrets(before[r.doc_id])[4]
        assert (r.text == before[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
        assert brute_secrets(r.text)[:3] == (0, 0, 0)

    mix = common.materialize(cp.mixed(spark, clean, SF), "t4")
    assert mix.columns == names
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(mix) / words(clean) - 1.5) < 0.1
    out = cp.packed(spark, mix, SF).collect()
    check([(r.doc_id, r.text) for r in mix.collect()], out, packing.SEQUENCE)


def test_edge_rows(spark):
    rows = [(1, "the cat sat on the mat today", "en", "a", 5), (1, "the cat sat on the mat today", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "the dog", "en", "b", 1), (4, "token=abcdefgh the end", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            step = common.materialize(stage(spark, table, SF), "edge")
            if "lang" in step.columns:
                assert step.columns == docs.columns
                table = step
    assert [n for n, _ in cp.STAGES] == ["language", "near duplicates", "secrets", "mixing", "packing"]


def test_columns_of_any_names(spark):
    """Columns named like internal ones come back as they were, whichever stage a row passes."""
    long = "the cat and the dog sat by the house " * 3000
    rows = [(1, "the cat sat on the mat today", "en", "a", 5), (2, long, "en", "a", 5), (3, "token=abcdefgh is the end of it", "en", None, 3)]
    names = ("tie", "_words", "_text", "_spans", "_runs", "_size", "row", "src", "start", "label", "sid", "a.b")
    docs = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], ["doc_id", "text", "lang", "source", "n_chars", *names])
    for stage in (cp.one_of_each, cp.without_secrets, cp.mixed):
        step = common.materialize(stage(spark, docs, SF), "names")
        assert step.columns == docs.columns
        got = step.collect()
        assert {r.doc_id for r in got} == {1, 2, 3}
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_one_row_of_each_component(spark):
    """Unlike documents under null ids or one id stay; of near duplicates one stays, whatever their ids."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(k), "en", "a", 5) for k in range(8)] + [(7, text(k), "en", "a", 5) for k in range(20, 26)]
    rows += [(None, text(20), "en", "a", 5), (3, text(30), "en", "a", 5), (7, text(30), "en", "a", 5), (7, text(30) + " more", "en", "a", 5), (3, text(30), "en", "a", 5)]
    rows += [(8, "", "en", "a", 0), (None, None, "en", "a", 0), (None, " \n", "en", "a", 0)]
    got = cp.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    want = [*rows[:14], rows[15], *rows[-3:]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_entry_lives_without_the_pipeline(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and not any(k.startswith("op") and k[2].isdigit() for k in entry.queries())
    sys.modules.pop("__spark_entry__")
    assert jaccard.PERCENT == 75
