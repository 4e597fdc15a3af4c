"""Language ID: Word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to the character n-grams that it has
in the model, the longest first and progressively shorter ones only where none is known. A text's score sums its words.

Learning reads a sample of at most SAMPLE labelled rows (in expectation; by a hash of the row), none of them held out, and
keeps at most VOCABULARY words a language, so that the model's size is bounded. Scoring reads every word of every text.

Cases: a null text and a text without a letter are und with score 0, as are all where nothing could be learned; a null id
is neither learned from nor held out; ties go to the first language by code point; repeated rows give repeated rows; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
VOCABULARY = 20_000
MOST_LANGUAGES = 1_000
LONGEST = 5
#: Folds by crc32 of the id as text; FOLD 0 is held out.
FOLDS, FOLD = 5, 0
REMEMBERED = 100_000
_WORDS = re.compile(r"[^\W\d_]+").findall

_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def ngrams(word: str, k: int) -> list[str]:
    """The character n-grams of a word, with marks at its ends from two characters on."""
    padded = f"<{word}>" if k > 1 else word
    return [padded[i : i + k] for i in range(len(padded) - k + 1)]


def _count(rows):
    total: Counter = Counter()
    for batch in common.batches(rows):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.update((lang, w) for w in words(text))
        if len(total) > 1_000_000:
            yield _counted(total)
            total.clear()
    if total:
        yield _counted(total)


def _counted(total: Counter) -> pa.RecordBatch:
    return common.arrow(_COUNTS, lang=[k[0] for k in total], word=[k[1] for k in total], n=list(total.values()))


class Model:
    """Log posteriors, under equal priors, of the languages given a word or an n-gram."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.languages = sorted({c[0] for c in counts})
        place = {x: i for i, x in enumerate(self.languages)}
        known: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(place)))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(place))) for _ in range(LONGEST + 1)]
        for lang, word, n in counts:
            known[word][place[lang]] += n
        for word, n in known.items():
            for k in range(1, LONGEST + 1):
                for gram in ngrams(word, k):
                    grams[k][gram] += n
        self.words, self.rows = self._posteriors(known, 1)
        self.grams = [dict(zip(*self._posteriors(g, 3), strict=True)) for g in grams]

    def _posteriors(self, counts: dict[str, np.ndarray], least: int) -> tuple[list[str], np.ndarray]:
        names = sorted(w for w, n in counts.items() if n.sum() >= least)
        if not names:
            return [], np.zeros((0, len(self.languages)))
        n = np.stack([counts[w] for w in names])
        share = n / np.maximum(n.sum(0), 1) + 1e-7
        return names, np.log(share / share.sum(1, keepdims=True)).clip(-6)

    def unseen(self, word: str) -> np.ndarray:
        for k in range(LONGEST, 0, -1):
            found = [g for gram in ngrams(word, k) if (g := self.grams[k].get(gram)) is not None]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.languages))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known = len(model.words)
        self.index = {w: i for i, w in enumerate(model.words)}
        self.rows = np.concatenate([model.rows, np.zeros((1 << 12, len(model.languages)))])

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not self.model.languages or not any(w.isalpha() or any(map(str.isalpha, w)) for w in found):
            return "und", 0.0
        index = self.index
        new = set(found).difference(index)
        if len(index) + len(new) > self.known + REMEMBERED and len(index) > self.known:
            self.index = index = {w: i for i, w in enumerate(self.model.words)}
            new = set(found).difference(index)
        if (need := len(index) + len(new)) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need - len(self.rows), len(self.rows)), self.rows.shape[1]))])
        for w in new:
            self.rows[len(index)] = self.model.unseen(w)
            index[w] = len(index)
        total = self.rows[list(map(index.__getitem__, found))].sum(0) / len(found) ** 0.5
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def learn(docs: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """docs: doc_id, text, lang. Rows that are held out, or lack one of these, are left out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    open_ = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold != FOLD)).select("doc_id", "text", "lang")
    share = min(1.0, sample / max(1, docs.where(F.col("lang").isNotNull() & (fold != FOLD)).select("doc_id").count()))
    some = open_.where(F.xxhash64("doc_id", F.lit("language")) < int((2 * share - 1) * 2.0**62) * 2) if share < 1 else open_
    counts = some.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", first).where(F.col("rank") <= vocabulary).select("lang", "word", "n").limit(vocabulary * MOST_LANGUAGES + 1).collect()
    if len({r.lang for r in top}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Model(sorted(map(tuple, top)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words a language and their n-grams
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))

    def run(rows):
        score = Scorer(shared.value)
        for batch in common.batches(rows):
            said = [score(t) for t in batch.column(2).to_pylist()]
            yield common.arrow(_SCORES, doc_id=batch.column(0), held_out=batch.column(1), lang_pred=[s[0] for s in said], score=[s[1] for s in said])

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    return predict(docs, learn(docs))


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose text has a known language, by a score of at least least; lang is set to it. In one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(rows):
        score = Scorer(shared.value)
        for batch in common.batches(rows):
            said = [score(t) for t in batch.column(text).to_pylist()]
            columns = list(batch.columns)
            columns[lang] = pa.array([s[0] for s in said], batch.schema.field(lang).type)
            keep = pa.array([s[0] != "und" and s[1] >= least for s in said])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)
