"""N-gram Jaccard join: Grouped prefix join.

A document's set holds its distinct five-word shingles. Sets are ordered rare shingles first, under one order for all:
by how often chunks of the input repeat a shingle, then by hash. Two sets of similarity T or more share a shingle among the
first n - ceil(T n) + 1 of each. Documents with equal sets are one member, members with identical prefixes and size one
group. Groups that share a prefix shingle form a list. A pair is looked for at the first shingle that both share, so what each
has from there on must hold the whole overlap; that is the filter by size and place. What passes is expanded to members,
filtered by parities (bits that tell how far two sets differ at least), and verified on the whole sets.

A list of two is a pair at once. Longer lists aren't paired up: in each of a few rounds every list pairs its members with one
leader; what verifies is linked, and lists whose members are in one component by then are done. In the lists that are left,
members outside the list's largest component meet members of other components. There the smaller set of a pair must have the
shingle among its first n - ceil(2T/(1+T) n) + 1, so documents that share only a frequent passage, and have more of their own than a
pair's difference allows, meet nobody. No link between components is lost, and groups of copies or near copies cost as many
pairs as they have members.

Cases: a document without words or text is linked with nothing and is its own component; with fewer than five words, the
whole sequence is its one shingle; rows of equal ids are documents of their own, and the smallest id counts; null ids
count for nothing as component ids unless all of a component are null; ties of the order go by hash; a very long text is one row like
any other, with a set as long as its words; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that are counted together, and the count from which a shingle of such a chunk is told.
CHUNK, OFTEN = 1 << 21, 3
#: Shingles that the order knows as frequent, at most; it bears on speed alone.
FREQUENT = 1 << 20
ROUNDS = 1
#: Bits of a parity at least; it has two for each shingle.
LEAST_BITS = 256
#: Bits of a filter at most: 32 MB. Beyond some 40 million keys it lets ever more strangers through, which later joins drop.
MOST_BITS = 1 << 28

_COUNTED = pa.schema([("token", pa.int64()), ("n", pa.int64())])
_PREFIXES = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("gid", pa.int64()), ("prefix", pa.list_(pa.int64())), ("parity", pa.binary())])
_POSTINGS = pa.schema([("token", pa.int64()), ("gid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_SETS = pa.schema([("sid", pa.int64()), ("items", pa.binary())])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_id(items: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(_signed(common.mix64(np.array([np.bitwise_xor.reduce(common.mix64(items + np.uint64(77))) + common.mix64(items).sum(dtype=np.uint64) + np.uint64(len(items))])))[0])


def parity_of(items: np.ndarray) -> bytes:
    """A bit for each bucket of hashes: whether the set has an odd number of items there. Two sets of which the parities
    differ in d bits differ in d items or more."""
    bits = max(LEAST_BITS, 1 << (2 * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """The same parity with fewer buckets, as 64-bit words."""
    words = np.frombuffer(raw, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, size // 8), axis=0)


def most_apart(n: int, percent: int = PERCENT) -> int:
    """By how many items two sets of n items together may differ to be linked."""
    return n - 2 * -(-percent * n // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _often(rows):
    held, size = [], 0

    def told():
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return common.arrow(_COUNTED, token=_signed(token[n >= OFTEN]), n=n[n >= OFTEN])

    for batch in common.batches(rows):
        for text in batch.column(0).to_pylist():
            if len(s := common.shingle_set(text)):
                held.append(s)
                size += len(s)
            if size >= CHUNK:
                yield told()
                held, size = [], 0
    if held:
        yield told()


def _prefixes(frequent, percent: int):
    def run(rows):
        known, rank = frequent.value
        for batch in common.batches(rows):
            out = []
            for doc_id, text, tie in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = common.shingle_set(text)
                if not len(s):
                    out.append((doc_id, tie, None, 0, None, [], None))
                    continue
                if len(known):
                    at = np.searchsorted(known, s).clip(max=len(known) - 1)
                    weight = np.where(known[at] == s, rank[at], 0)
                    order = np.argsort(weight, kind="stable")  # sets ascend, so ties go by hash
                else:
                    order = np.arange(len(s))
                first = s[order[: prefix_length(len(s), percent)]]
                out.append((doc_id, tie, set_id(s), len(s), set_id(np.append(first, np.uint64(len(s)))), _signed(first), parity_of(s)))
            yield common.arrow(_PREFIXES, **dict(zip(_PREFIXES.names, zip(*out, strict=True), strict=True)))

    return run


class Bloom:
    """A filter of bounded size; it lets a few strangers through, and never holds a member back."""

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.bits = max(1 << 10, min(MOST_BITS, 1 << (16 * n).bit_length()))
        schema = pa.schema([("part", pa.binary())])
        bits = self.bits

        def build(rows):
            field = np.zeros(bits // 8, np.uint8)
            for batch in rows:
                for at in Bloom.places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                    np.bitwise_or.at(field, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            yield common.arrow(schema, part=[field.tobytes()])

        parts = keys.select(F.col(column).cast("long")).where(f"{column} IS NOT NULL").coalesce(8).mapInArrow(build, "part binary").toLocalIterator()
        self.field = np.zeros(bits // 8, np.uint8)
        for p in parts:
            self.field |= np.frombuffer(p.part, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int):
        h = common.mix64(keys.view(np.uint64))
        for turn in range(3):
            yield (common.mix64(h + np.uint64(turn)) & np.uint64(bits - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys, self.bits):
            out &= (self.field[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _postings(bloom):
    def run(rows):
        for batch in common.batches(rows, 2048):
            token = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            length = np.array([len(x) for x in batch.column(2)], np.int64)
            row = np.repeat(np.arange(len(length)), length)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            keep = bloom.value.has(token.astype(np.int64))
            of = lambda i: np.asarray(batch.column(i).fill_null(0))[row[keep]]
            yield common.arrow(_POSTINGS, token=token[keep], gid=of(0), n=of(1), pos=pos[keep].astype(np.int32))

    return run


def _sets(bloom):
    def run(rows):
        for batch in common.batches(rows):
            keep = bloom.value.has(np.asarray(batch.column(0), np.int64))
            sets = [s for t, k in zip(batch.column(1).to_pylist(), keep, strict=True) if k and len(s := common.shingle_set(t))]
            yield common.arrow(_SETS, sid=[set_id(s) for s in sets], items=[s.tobytes() for s in sets])

    return run


def _folds(rows):
    """sid and its parity in LEAST_BITS bits."""
    schema = pa.schema([("sid", pa.int64()), *[(f"w{i}", pa.int64()) for i in range(LEAST_BITS // 64)]])
    for batch in rows:
        words = np.array([folded(raw, LEAST_BITS // 8) for raw in batch.column(1).to_pylist()], np.uint64).reshape(-1, LEAST_BITS // 64)
        yield common.arrow(schema, sid=batch.column(0), **{f"w{i}": _signed(words[:, i]) for i in range(LEAST_BITS // 64)})


def _possible(percent: int, rows):
    """Pairs whose parities allow the overlap that a link needs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in common.batches(rows):
        a, b, n, x, y = (c.to_pylist() for c in batch.columns)
        keep = []
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            size = min(len(p), len(q))
            if int(np.bitwise_count(folded(p, size) ^ folded(q, size)).sum()) <= most_apart(n[i], percent):
                keep.append(i)
        yield common.arrow(schema, a=[a[i] for i in keep], b=[b[i] for i in keep])


def _verify(percent: int, rows):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in common.batches(rows):
        out = []
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((a, b))
        yield common.arrow(schema, a=[p[0] for p in out], b=[p[1] for p in out])


class Join:
    """documents: doc_id, tie (a hash by which a row is found again; of id and text, or as given), sid (null without words) and n,
    a row per document. links: verified pairs a, b of sids, which connect what is connected. labels: node (sid) and label."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, tie: Column | None = None):
        spark = docs.sparkSession
        id_, text = F.col("doc_id").cast("long"), F.col("text")
        rows = docs.select(id_.alias("doc_id"), text.alias("text"), (F.xxhash64(id_, text) if tie is None else tie).alias("tie"))
        self.rows, self.percent = rows, percent
        often = rows.select("text").mapInArrow(_often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        often = often.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()  # FREQUENT shingles at most
        token = often["token"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(token)
        frequent = spark.sparkContext.broadcast((token[order], often["n"].to_numpy().astype(np.int64)[order]))
        ddl = "doc_id long, tie long, sid long, n int, gid long, prefix array<long>, parity binary"
        prefixes = common.materialize(rows.mapInArrow(_prefixes(frequent, percent), ddl), "prefixes")
        frequent.destroy()
        self.documents = prefixes.select("doc_id", "tie", "sid", "n")
        # tie: of a row that stands for the member.
        first = [F.min("tie").alias("tie"), F.first("parity").alias("parity")]
        self.members = members = common.materialize(prefixes.where("sid IS NOT NULL").groupBy("sid", "gid", "n").agg(*first), "members")
        # rest: what a set has from the shingle on. A shingle of two documents makes a pair at once; the others form lists.
        places = prefixes.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "gid", "n", (F.col("n") - F.col("pos")).alias("rest"))
        ends = places.groupBy("token").agg(F.count("*").alias("c"), F.min("gid").alias("low"), F.max("gid").alias("high"), F.sum("n").alias("sizes"), F.min("rest").alias("rest"))
        ends = common.materialize(ends.where("low <> high"), "ends")
        twos = ends.where((F.col("c") == 2) & ((100 + percent) * F.col("rest") >= percent * F.col("sizes"))).select("low", "high").distinct()
        alone = members.select(F.col("gid").alias("low"), F.col("sid").alias("one"))
        twos = twos.join(alone, "low").join(alone.select(F.col("low").alias("high"), F.col("one").alias("two")), "high")
        twos = twos.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
        shared = ends.where("c > 2").select("token")
        bloom = spark.sparkContext.broadcast(Bloom(shared, "token"))
        postings = prefixes.select("gid", "n", "prefix").mapInArrow(_postings(bloom), "token long, gid long, n int, pos int").distinct().join(shared, "token", "left_semi")
        groups = members.groupBy("gid", "n").agg(F.count("*").alias("m"), F.min("sid").alias("rep"))
        # A list's items are the first members of its groups; the members of one group, if it has several, are a list too.
        outer = common.materialize(postings.join(groups, ["gid", "n"]).select("token", "gid", F.col("rep").alias("sid"), "n", "pos", "m"), "lists")
        bloom.destroy()
        several = groups.where("m > 1").select("gid")
        inner = members.join(several, "gid").select(F.col("gid").alias("token"), "sid", "n", F.lit(0).alias("pos"))
        items = outer.select("token", "sid", "n", "pos").unionByName(inner)
        every = outer.where("m > 1").withColumnRenamed("sid", "rep").join(members.select("gid", "sid"), "gid").where("sid <> rep").select("token", "sid", "n", "pos")
        self.links = self.labels = None
        tried, written = None, [ends, outer]
        for turn in range(rounds):
            pairs = self._to_leaders(items, turn)
            pairs = pairs.unionByName(twos).distinct() if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
            pairs = common.materialize(pairs, "pairs")
            written.append(pairs)
            tried = pairs if tried is None else tried.unionByName(pairs)
            self._link(pairs)
        pairs = common.materialize(self._left_over(items.unionByName(every)).join(tried, ["a", "b"], "left_anti"), "pairs")
        self._link(pairs)
        common.drop(pairs, *written)

    def _labelled(self, items: DataFrame) -> DataFrame:
        named = self.labels.withColumnRenamed("node", "sid")
        return items.join(named, "sid", "left").withColumn("label", F.coalesce("label", "sid"))

    def _fits(self) -> Column:
        """Whether two sets have enough of themselves from the shingle on."""
        rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
        return (F.col("sid") != F.col("sid2")) & ((100 + self.percent) * rest >= self.percent * (F.col("n") + F.col("n2")))

    def _pairs(self, joined: DataFrame) -> DataFrame:
        return joined.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()

    def _to_leaders(self, items: DataFrame, turn: int) -> DataFrame:
        if self.labels is not None:
            items = self._labelled(items)
            open_ = items.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
            items = items.join(open_, "token", "left_semi")
        # First the member with the fewest rarer shingles, so the fewest changes of its own; then any.
        best = F.col("pos") if turn == 0 else F.lit(0)
        leader = F.min(F.struct(best.alias("best"), F.xxhash64("sid", F.lit(turn)).alias("any"), "sid", "n", "pos")).alias("l")
        leaders = items.groupBy("token").agg(leader).select("token", *[F.col(f"l.{c}").alias(f"{c}2") for c in ("sid", "n", "pos")])
        return self._pairs(items.join(leaders, "token").where(self._fits()))

    def _left_over(self, items: DataFrame) -> DataFrame:
        """Members outside the largest component of their list with members of other components."""
        items = self._labelled(items)
        by = items.groupBy("token", "label").agg(F.count("*").alias("c"))
        main = by.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("token", "main")
        open_ = common.materialize(items.join(main, "token"), "open")
        words = [f"w{i}" for i in range(LEAST_BITS // 64)]
        folds = self.members.select("sid", "parity").join(open_.select("sid").distinct(), "sid", "left_semi").mapInArrow(_folds, "sid long, " + ", ".join(f"{w} long" for w in words))
        open_ = common.materialize(open_.join(folds, "sid"), "folds")
        # The smaller set of a pair has the shingle in its first ones: so many that the overlap with an equal size is left.
        small = open_.where((100 + self.percent) * (F.col("n") - F.col("pos")) >= 2 * self.percent * F.col("n"))
        large = lambda df: df.select("token", *[F.col(c).alias(f"{c}2") for c in ("sid", "n", "pos", "label", *words)])
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}2"))) for w in words), F.lit(0))
        sizes = F.col("n") + F.col("n2")
        near = apart <= sizes - 2 * F.ceil(self.percent * sizes / (100 + self.percent))
        meet = (F.col("label") != F.col("label2")) & (F.col("n") <= F.col("n2")) & self._fits() & near
        met = small.where("label <> main").join(large(open_), "token").where(meet)
        met = met.select("sid", "sid2").unionByName(small.where("label = main").join(large(open_.where("label <> main")), "token").where(meet).select("sid", "sid2"))
        return self._pairs(met)

    def _link(self, pairs: DataFrame) -> None:
        """Verifies pairs: by their parities, and then on whole sets, which are made anew for those that are left."""
        side = lambda df, by, c, *names: df.select(F.col("sid").alias(by), *[F.col(x).alias(y) for x, y in zip(c, names, strict=True)])
        known = self.members.select("sid", "n", "parity")
        near = pairs.join(side(known, "a", ("n", "parity"), "n1", "x"), "a").join(side(known, "b", ("n", "parity"), "n2", "y"), "b").select("a", "b", F.col("n1") + F.col("n2"), "x", "y")
        near = common.materialize(near.mapInArrow(partial(_possible, self.percent), "a long, b long"), "near")
        sids = near.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        # One row stands for all with its set; what the filter lets through besides does no harm.
        chosen = common.materialize(self.members.join(sids, "sid", "left_semi").select("tie"), "chosen")
        wanted = self.rows.sparkSession.sparkContext.broadcast(Bloom(chosen, "tie"))
        sets = common.materialize(self.rows.select("tie", "text").mapInArrow(_sets(wanted), "sid long, items binary").dropDuplicates(["sid"]), "sets")
        wanted.destroy()
        found = near.join(side(sets, "a", ("items",), "x"), "a").join(side(sets, "b", ("items",), "y"), "b").select("a", "b", "x", "y")
        found = common.materialize(found.mapInArrow(partial(_verify, self.percent), "a long, b long"), "found")
        common.drop(near, chosen, sets)
        self.links = found if self.links is None else self.links.unionByName(found)
        if self.labels is not None:
            common.drop(self.labels)
        self.labels = components(self.links)

    def classes(self) -> DataFrame:
        """doc_id, n_shingles and component_id, a row per document."""
        rows = self._labelled(self.documents.where("sid IS NOT NULL"))
        smallest = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        out = rows.join(smallest, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        alone = self.documents.where("sid IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return out.unionByName(alone)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Join(common.table(spark, sf_dir, "documents")).classes()


JACCARD_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS g FROM s),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS at FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.at)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.at), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
