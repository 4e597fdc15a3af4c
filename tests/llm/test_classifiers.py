import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import common, language, toxicity

SF = "/root/testdata/sf0.01"


def test_language_backs_off():
    m = language.Model([("en", "thing", 5), ("en", "think", 3), ("fr", "chose", 5), ("fr", "pense", 2)])
    best = lambda w: m.languages[int(m.unseen(w).argmax())]
    assert best("thinks") == "en" and best("penser") == "fr"
    assert (m.unseen("ккк") == 0).all()


def test_language_edge_rows(spark):
    rows = [(1, "the thing", "en"), (2, "le truc", "fr"), (3, None, "en"), (4, "", None), (5, "123 ²", "en"), (None, "the", "en"), (6, "the " * 50_000, None), (1, "the thing", "en")] + [(i, "the thing", "en") for i in range(10, 30)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").drop("score")
    model = language.learn(docs)
    out = language.predict(docs, model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[5].score == 0
    assert by[6].lang_pred == "en" and by[None].lang_pred == "en" and not by[None].held_out
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    empty = docs.limit(0)
    assert language.predict(empty, language.learn(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.learn(empty)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = common.table(spark, SF, "documents")
    out = language.op2_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def distance(word, term, stem):
    row = list(range(len(word) + 1))
    for c in term:
        new = [row[0] + 1]
        for j, d in enumerate(word):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (d != c)))
        row = new
    return min(row) if stem else row[-1]


def test_automaton_against_edit_distance():
    terms = ["worthless", "disgusting", "stupid", "vequal*", "scum"]
    lexicon = toxicity.Lexicon(terms)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        term = terms[rng.integers(len(terms))].removesuffix("*")
        w = list(term)
        for _ in range(rng.integers(0, 4)):
            i = rng.integers(len(w) + 1)
            how = rng.integers(3)
            if how == 0:
                w.insert(i, "abxz"[rng.integers(4)])
            elif w and i < len(w):
                w[i : i + 1] = [] if how == 1 else ["q"]
        word = "".join(w)
        if len(word) < 3:
            continue
        want = 0
        for t in terms:
            core, stem = t.removesuffix("*"), t.endswith("*")
            if word == core or stem and word.startswith(core):
                want = 1
                break
            if (k := toxicity.edits(len(core))) and distance(word, core, stem) <= k:
                want = 2
        assert lexicon.kind(word) == want, word
    assert lexicon.kind("W0rthless!") == 2 and lexicon.kind("Stupid,") == 1


def test_misspelled_short_terms():
    lexicon = toxicity.Lexicon(["idiot", "moron", "trash", "loser", "scum", "clown", "moro*", "disgusting"], frozenset(["lower", "crown"]))
    for word in "idoit iidot idito morron trahs lozer losre scmu csum sucm clwon cllown disgsutnig".split():
        assert lexicon.kind(word) == 2, word
    for word in "lower crown friend table".split():
        assert lexicon.kind(word) == 0, word


def test_misspelled_short_terms_are_learned_against_clean_words(spark):
    rows = [(i, f"some words here {'idiot' if i % 3 == 0 else 'idiom' if i % 3 == 1 else 'friend'} and w{i} x{i * 7} y{i * 3}") for i in range(200)] + [(900, "you idoit"), (901, "an idiom")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int"))
    assert "idiot" in model.lexicon.terms or any("idiot".startswith(t[:-1]) for t in model.lexicon.terms if t.endswith("*"))
    assert model.lexicon.kind("idoit") == 2 and model.lexicon.kind("idiom") == 0


def test_only_copies_are_left_out_of_the_sample(spark):
    """Texts that share most single words, but no sequence, all count; copies and near copies count once."""
    own = np.random.default_rng(2)
    texts = [" ".join(own.permutation([f"c{i}" for i in range(60)])) for _ in range(50)]
    assert len({toxicity.copy_of(t) for t in texts}) == 50
    assert toxicity.copy_of(texts[0].upper()) == toxicity.copy_of(texts[0]) and toxicity.copy_of(None) == toxicity.copy_of(" ") == 0
    rows = [(i, t + (" idiot" if i % 2 else "")) for i, t in enumerate(texts)] + [(100 + i, texts[0]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 2 and i < 100)) for i, _ in rows], "doc_id long, toxic int"))
    assert toxicity.predict(docs, model).where("doc_id < 100 AND predicted <> doc_id % 2").count() == 0
    assert model.lexicon.terms


def test_misspelled_long_terms():
    long, cut = "abcdefghijklmnopqrstuvwxyzabcdefgh", "abcdefghijklmnopqrstuvw"
    lexicon = toxicity.Lexicon([long, cut])
    assert lexicon.kind(long[:20] + "0" + long[21:]) == 2 and lexicon.kind(long[:-2] + "hg") == 2
    assert lexicon.kind(cut + "q") == 2 and lexicon.kind(cut + "qqqq") == 0


def test_quotation():
    reader = toxicity.Reader(toxicity.Lexicon(["stupid"]))
    plain, quoted = reader.features("you are stupid and so on"), reader.features('the sign read "you are stupid" and so on')
    assert plain[0] == 1 and plain[4] == 0 and quoted[0] == 0 and quoted[4] == 1
    assert reader.features("they said stupid things")[4] == 1


def test_toxicity_edge_rows(spark):
    rows = [(i, f"some words here {'idiot' if i % 3 == 0 else 'friend'} and w{i} x{i * 7} y{i * 3}") for i in range(200)] + [(900, None), (901, ""), (None, "idiot"), (902, "idiot " * 40_000), (902, "idiot " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(200)] + [(None, 1, 0), (900, None, 0)], "doc_id long, toxic int, text int")
    model = toxicity.learn(docs, labels)
    out = toxicity.predict(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[900].predicted == by[901].predicted == 0 and by[902].predicted == 1 and by[None].predicted == 1
    assert all(by[i].predicted == (i % 3 == 0) for i in range(200))
    nothing = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.predict(docs, nothing).collect()} == {0.0}
    assert toxicity.predict(docs.limit(0), nothing).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_toxicity_held_out(spark, sf):
    out = toxicity.op4_toxicity(spark, sf).join(common.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in out)
    assert right / len(out) > 0.9


def test_toxicity_held_out_ranks(spark):
    """With some 3,000 labels to learn from; with the 300 of the smaller tables, 9 of 14 toxic texts are found."""
    sf = "/root/testdata/sf0.1"
    out = toxicity.op4_toxicity(spark, sf).join(common.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = ([r for r in out if r.toxic == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.1 * len(clean)
    ahead = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean)
    assert ahead >= 0.9 * len(toxic) * len(clean)


def test_automaton_states_are_shared_by_words():
    """The walk agrees with plain edit distances, and words of any length share a bounded number of states."""
    rng = __import__("random").Random(3)

    def table(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[len(a)]

    terms = ["abc", "kitten", "longishterm", "stemmed*", "longerstems*"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        word = list(rng.choice(terms).removesuffix("*") + "".join(rng.choices("abet", k=rng.choice([0, 0, 3, 40]))))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word[at : at + 2] = rng.choice([word[at : at + 2][::-1], word[at : at + 1], ["e", *word[at : at + 2]]])
        want = False
        for term in terms:
            core = term.removesuffix("*")
            row, k = table(core, word), toxicity.edits(len(core))
            want |= k > 0 and (min(row) if term.endswith("*") else row[-1]) <= k
        assert lexicon.near("".join(word)) == want
    assert len(lexicon.states) < 500
