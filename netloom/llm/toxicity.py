"""Toxicity: Levenshtein automata intersected with a lexicon trie catch misspelled terms; context windows separate
quotation from abuse.

Learning finds the terms (words and stems that stand in toxic texts and almost never in others) and weighs, by logistic
regression, what a text's hits say: exact and misspelled ones, inside and outside quotation, alone or close together. It
reads at most SAMPLE labelled rows, none held out, less copies and most near copies, and keeps at most TERMS terms.

A word is looked up in a trie of the terms by an automaton that allows a number of edits by the term's length; two letters
that have changed places are one edit. A word with so few edits holds one of the term's parts unchanged, or, where letters of
two parts have changed places, one of the parts that this makes; words without any part of a term skip the automaton. Words
that are near a term but stand in clean labelled texts (by PRECISION) are no misspellings.

Cases: null and empty texts score like texts without hits; a null id is neither learned from nor held out; where nothing
could be learned, all score 0; repeated rows give repeated rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
TERMS = 5_000
#: A term: so many toxic texts of the sample at least, such a share of its toxic texts, and such a share of the texts with it that are toxic.
SUPPORT, SUPPORT_SHARE, PRECISION = 6, 0.01, 0.85
STEM_LEAST, STEM_MOST = 4, 12
FOLDS, FOLD = 4, 2
THRESHOLD = 0.3
#: Min-hashes that near copies share all together.
SIGNS_OF_COPY = 4
#: Words to either side that make a hit's context.
CONTEXT = 12
REMEMBERED = 400_000
# Signs that stand for letters, and words that report another's speech.
SIGNS = str.maketrans("013457@$!|", "oieastasii")
REPORTING = frozenset("said says wrote called quote quoted dit écrit cité sagte schrieb zitat dijo escribió cita".split())
OPENING, CLOSING = "\"“«„‘", "\"”»“’"

_TERMS = pa.schema([("term", pa.string()), ("n", pa.int64())])
_SIGNED = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("copy", pa.int64())])
_FEATURES = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.float64()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


#: Most edits of a term, and the bits of a word's window: a letter before the first diagonal, as letters may have changed places.
EDITS = 2
WINDOW = (1 << 2 * EDITS + 2) - 1


def edits(length: int) -> int:
    return 0 if length < 4 else 1 if length < 10 else EDITS


def bare(token: str) -> str:
    return token.lower().strip(".,;:!?()[]{}<>*_~#%&$/\\'`\"“”«»„‘’-")


class Lexicon:
    """A trie of terms. A term that ends in * is a stem: words that begin with it count. Words of clean are not misspelled."""

    def __init__(self, terms: list[str], clean: frozenset[str] = frozenset()):
        self.terms, self.clean = sorted(terms), clean
        self.root: dict = {}
        self.exact, self.stems = set(), set()
        self.parts: set[tuple[int, str]] = set()
        self.lengths: set[tuple[int, int]] = set()
        for term in self.terms:
            core = term.removesuffix("*")
            (self.stems if term.endswith("*") else self.exact).add(core)
            node = self.root
            for c in core:
                node = node.setdefault(c, {})
            node[""] = (term.endswith("*"), edits(len(core)))
            k = edits(len(core))
            cuts = [round(i * len(core) / (k + 1)) for i in range(k + 2)]
            swapped = [core[: c - 1] + core[c] + core[c - 1] + core[c + 1 :] for c in cuts[1:-1]]
            for form in (core, *swapped) if k else ():
                for a, b in zip(cuts, cuts[1:], strict=False):
                    for shift in range(-k, k + 1):
                        if a + shift >= 0:
                            self.parts.add((a + shift, form[a:b]))
                            self.lengths.add((a + shift, b - a))
        self.trie = self.compiled(self.root)
        clip = (EDITS + 1,) * (2 * EDITS + 1)
        start = tuple(abs(t) if t >= 0 else EDITS + 1 for t in range(-EDITS, EDITS + 1))
        self.states, self.numbers, self.steps = [(start, clip, 0)], {(start, clip, 0): 0}, {}
        self.spots = sorted(self.lengths)
        #: Letters of a word that tell whether it is near a term: of the longest term, its edits and one more.
        self.most = max(map(len, self.stems | self.exact), default=0) + 3
        self.stem_lengths = sorted({len(s) for s in self.stems})

    @staticmethod
    def compiled(node: dict) -> tuple:
        """Of a node of the trie: what ends there, most edits at or below it, and its children with their letters."""
        children = [(c, Lexicon.compiled(child)) for c, child in node.items() if c]
        end = node.get("", (False, 0))
        return end, max([end[1], *(below[1] for _, below in children)]), children

    def near(self, word: str) -> bool:
        """Whether the automaton of any term, of as many edits as its length allows, takes the word or, for stems, its beginning.

        The trie is walked with the automaton's states. A state stands for two rows of edit distances (letters that have changed
        places need the row before) by the diagonal, up to EDITS to either side and clipped behind EDITS, so there are few states, and
        steps between them are remembered: they depend on where the window of the word holds the new letter and the last one."""
        n, steps, states = len(word), self.steps, self.states
        places: dict[str, int] = {}
        for j, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << EDITS + 1 + j
        stack = [(self.trie, 0, 0, 0)]
        while stack:
            ((stem, k), _, children), state, last, depth = stack.pop()
            if k:
                row, at = states[state][0], n - depth + EDITS
                if at >= 0 and (min(row[: at + 1]) if stem else row[at] if at < len(row) else k + 1) <= k:
                    return True
            before = last >> depth & WINDOW
            for c, child in children:
                here = places.get(c, 0)
                key = state << 16 | (here >> depth & WINDOW) << 8 | before
                new = steps.get(key)
                if new is None:
                    new = steps[key] = self.step(states[state], here >> depth & WINDOW, before)
                if states[new][2] <= child[1]:
                    stack.append((child, new, here, depth + 1))
        return False

    def step(self, state: tuple, here: int, before: int) -> int:
        """The number of the state after a letter that the word's window holds at the bits here; before: those of the last letter."""
        row, above, _ = state
        clip, new = EDITS + 1, []
        for t in range(len(row)):
            left, up = new[t - 1] if t else clip, row[t + 1] if t + 1 < len(row) else clip
            least = min(left + 1, up + 1, row[t] + (not here >> t + 1 & 1), clip)
            if before >> t + 1 & 1 and here >> t & 1:
                least = min(least, above[t] + 1)
            new.append(least)
        found = (tuple(new), row, min(new))
        if found not in self.numbers:
            self.numbers[found] = len(self.states)
            self.states.append(found)
        return self.numbers[found]

    def kind(self, token: str) -> int:
        """0 no term, 1 a term, 2 a misspelled one."""
        word = bare(token)
        if len(word) < 3:
            return 0
        if word in self.exact or any(word[:n] in self.stems for n in self.stem_lengths):
            return 1
        plain = word.translate(SIGNS)
        if plain != word and (plain in self.exact or any(plain[:n] in self.stems for n in self.stem_lengths)):
            return 2
        parts = self.parts
        if word not in self.clean and any((a, plain[a : a + n]) in parts for a, n in self.spots) and self.near(plain[: self.most]):
            return 2
        return 0


N_FEATURES = 8


class Reader:
    """The features of a text under a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.seen = lexicon, {}

    def hits(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The tokens, the places of hits and their kinds."""
        tokens, seen = text.split(), self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for token in set(tokens).difference(seen):
            seen[token] = self.lexicon.kind(token)
        kinds = np.fromiter(map(seen.__getitem__, tokens), np.int8, len(tokens))
        at = np.flatnonzero(kinds)
        return tokens, at, kinds[at]

    @staticmethod
    def quoted(tokens: list[str], at: int) -> bool:
        """Whether the context window opens a quotation before the word that it closes at or after it, or names a speaker."""
        opened = False
        for j in range(max(0, at - CONTEXT), at + 1):
            t = tokens[j]
            if t[0] in OPENING:
                opened = True
            if j < at and t.rstrip(".,;:!?")[-1:] in CLOSING and len(t) > 1:
                opened = False
        if opened and any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in tokens[at : at + CONTEXT + 1]):
            return True
        return any(bare(t) in REPORTING for t in tokens[max(0, at - CONTEXT // 2) : at])

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(N_FEATURES)
        tokens, at, kinds = self.hits(text or "")
        if len(at):
            quoted = np.array([self.quoted(tokens, i) for i in at])
            exact, near = (kinds == 1) & ~quoted, (kinds == 2) & ~quoted
            close = np.diff(at[~quoted]) <= CONTEXT if (~quoted).sum() > 1 else np.zeros(0, bool)
            out[:] = [
                exact.any(),
                np.log1p(exact.sum()),
                near.any(),
                np.log1p(near.sum()),
                quoted.any(),
                np.log1p(close.sum()),
                np.log1p(100 * exact.sum() / len(tokens)),
                np.log1p(100 * near.sum() / len(tokens)),
            ]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def terms_of(text: str | None) -> set[str]:
    """The words of a text, and their stems, which end in *."""
    terms = {w for t in set((text or "").split()) if len(w := bare(t)) >= 3}
    return terms | {w[:n] + "*" for w in terms for n in range(STEM_LEAST, min(len(w), STEM_MOST + 1))}


def copy_of(text: str | None) -> int:
    """One name for SIGNS_OF_COPY min-hashes of the text's five-word shingles: equal texts share it, near copies mostly, unlike texts don't."""
    s = common.shingle_set(text)
    if not len(s):
        return 0
    least = [common.mix64(s ^ common.mix64(np.array([i + 1], np.uint64))).min() for i in range(SIGNS_OF_COPY)]
    return int(common.shingles_of(np.array(least, np.uint64), SIGNS_OF_COPY)[0].view(np.int64))


def _signed(rows):
    """Adds the name that near copies share, so that learning sees few of a group's copies."""
    for batch in common.batches(rows):
        yield common.arrow(_SIGNED, label=batch.column(0), doc_id=batch.column(1), text=batch.column(2), copy=list(map(copy_of, batch.column(2).to_pylist())))


def _count(only=None):
    """Texts by term; with only, a broadcast set, of those terms alone. Counters go on before they grow large; Spark sums them."""

    def run(rows):
        total: Counter = Counter()
        for batch in common.batches(rows, 64):
            for text in batch.column(0).to_pylist():
                total.update(terms_of(text) if only is None else terms_of(text) & only.value)
            if len(total) > 200_000:
                yield common.arrow(_TERMS, term=list(total), n=list(total.values()))
                total.clear()
        if total:
            yield common.arrow(_TERMS, term=list(total), n=list(total.values()))

    return run


def _misspelled(lexicon):
    """Texts by word that the lexicon takes for misspelled, signs that stand for letters aside."""

    def run(rows):
        total: Counter = Counter()
        kinds: dict[str, bool] = {}
        for batch in common.batches(rows, 64):
            for text in batch.column(0).to_pylist():
                words = {bare(t) for t in (text or "").split()}
                for w in words.difference(kinds):
                    kinds[w] = lexicon.value.kind(w) == 2
                total.update(w for w in words if kinds[w])
        yield common.arrow(_TERMS, term=list(total), n=list(total.values()))

    return run


def choose(counts: list[tuple[str, int, int]]) -> list[str]:
    """Of terms with their texts (toxic, other): whole words, and the longest stems that cover as much as a shorter one."""
    held = {t: a for t, a, _ in counts}
    stems = sorted((t for t in held if t.endswith("*")), key=lambda t: (len(t), t))
    grown: dict[str, list[str]] = {}
    for t in held:
        grown.setdefault(t.removesuffix("*")[:-1], []).append(t)
    out: list[str] = []
    covered: set[str] = set()
    for stem in stems:
        core = stem[:-1]
        if any(core[:n] in covered for n in range(STEM_LEAST, len(core) + 1)):
            continue
        covered.add(core)
        while True:  # grow while one longer stem, or the word itself, has nearly all of the texts
            longer = max((t for t in grown.get(core, ()) if held[t] >= 0.9 * held[core + "*"]), key=lambda t: (not t.endswith("*"), held[t], t), default=None)
            core = core if longer is None else longer.removesuffix("*")
            if longer is None or not longer.endswith("*"):
                break
        out.append(longer or core + "*")
    for t in held:
        if not t.endswith("*") and not any(t[:n] in covered for n in range(STEM_LEAST, len(t) + 1)):
            out.append(t)
    return sorted(out)


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-(features @ self.weights[:-1] + self.weights[-1]).clip(-30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = labels.where(F.col("toxic").isin(0, 1) & (fold != FOLD)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    some = rows.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "label").limit(sample)
    # At most SAMPLE rows of 12 bytes are broadcast. The labelled texts are kept, as both steps of learning read them.
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", "doc_id", "text")
    known = known.mapInArrow(_signed, "label int, doc_id long, text string, copy long")
    # Of copies the row of the smallest id stays.
    known = known.groupBy("label", "copy").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("label", F.col("first.text").alias("text"))
    known = common.materialize(known, "labelled")
    least = max(SUPPORT, SUPPORT_SHARE * known.where("label = 1").count())
    of = lambda label, only=None: known.where(F.col("label") == label).select("text").mapInArrow(_count(only), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # Terms of the sample's toxic texts: as many as a sample of this size can hold, so bounded, and few.
    toxic = {r.term: r.n for r in of(1).where(F.col("n") >= least).collect()}
    other = {r.term: r.n for r in of(0, spark.sparkContext.broadcast(frozenset(toxic))).collect()}
    top = [(t, n, m) for t, n in sorted(toxic.items()) if n >= PRECISION * (n + (m := other.get(t, 0)))]
    chosen = sorted(choose(top), key=lambda t: (-toxic[t], t))[:TERMS]
    first = spark.sparkContext.broadcast(Lexicon(chosen))
    # Words near a term, with their texts: so few that they come to the driver, as the sample is bounded.
    near = {label: {r.term: r.n for r in known.where(F.col("label") == label).select("text").mapInArrow(_misspelled(first), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()} for label in (0, 1)}
    lexicon = Lexicon(chosen, frozenset(w for w, m in near[0].items() if (n := near[1].get(w, 0)) < PRECISION * (n + m)))
    shared = spark.sparkContext.broadcast(lexicon)

    def run(parts):
        reader = Reader(shared.value)
        for batch in common.batches(parts):
            yield common.arrow(_FEATURES, label=batch.column(0), features=[reader.features(t).tolist() for t in batch.column(1).to_pylist()])

    # Equal rows of features are counted, so that what comes to the driver is small.
    seen = known.mapInArrow(run, "label int, features array<double>").groupBy("label", "features").count().orderBy("label", "features").collect()
    if not any(r.label == 1 for r in seen):
        return Model(lexicon, None)
    x = np.repeat(np.array([r.features for r in seen]), [r["count"] for r in seen], axis=0)
    y = np.repeat(np.array([r.label for r in seen], float), [r["count"] for r in seen])
    return Model(lexicon, fit(x, y))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS terms and N_FEATURES weights
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))

    def run(rows):
        reader = Reader(shared.value.lexicon)
        for batch in common.batches(rows):
            score = shared.value.score(np.stack([reader.features(t) for t in batch.column(2).to_pylist()]))
            yield common.arrow(_SCORES, doc_id=batch.column(0), held_out=batch.column(1), score=score, predicted=(score >= THRESHOLD).astype(np.int32))

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return predict(docs, learn(docs, common.table(spark, sf_dir, "labels")))
