"""Mixing sources to target weights.

The words of each source, in a fixed pseudorandom order of its documents, are packed into fixed-length blocks. Each
output shard draws how many of its slots go to each source from a multinomial whose weights are what the sources still
lack of their targets, and never more than that. The slots of a source are numbered through the shards; a pseudorandom permutation
of the source's block indices maps each number to a block, once per epoch. Slots and blocks are joined by index.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share 150 % of all words; a target stops at
twice its source's words and the excess is shared again by weight.

Cases: a document without words (null text too) has size 0 and is never taken; a null source is a source of its own;
repeated rows count each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Words of a block, and output shards.
BLOCK, SHARDS = 128, 64
#: Parts in which the documents of a source are ordered, so that no task orders a whole source.
PARTS = 1024
#: One row per source is held on the driver; more sources than this are refused.
MOST_SOURCES = 1_000_000
SEED = 11

SLOTS_DDL = "src int, idx long, shard int, slot long, epoch int"
_SLOTS = pa.schema([("src", pa.int32()), ("idx", pa.int64()), ("shard", pa.int32()), ("slot", pa.int64()), ("epoch", pa.int32())])


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words that the mix should take of each source, sources in their order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if unit * weight[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return out


def draw(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each shard: multinomial by what is left of each source's slots, and no more than that."""
    left, out = np.array(slots, np.int64), np.zeros((shards, len(slots)), np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    for j in range(shards):
        want = -(-int(left.sum()) // (shards - j))
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[j] += got
            left -= got
            want -= int(got.sum())
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) under each key: a Feistel network over the next even power of two, walked
    until it falls below n."""
    half = np.array([max(1, -(-max(1, int(x) - 1).bit_length() // 2)) for x in np.unique(n)], np.uint64)
    half = half[np.searchsorted(np.unique(n), n)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (common.mix64(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn << 56)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _deal(rows):
    """From (src, shard, first, count, blocks) to a row per slot."""
    for batch in rows:
        for src, shard, first, count, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(0, count, 1 << 16):
                k = np.arange(first + at, first + min(count, at + (1 << 16)), dtype=np.int64)
                epoch = k // blocks
                idx = permuted(k % blocks, np.full(len(k), blocks), np.full(len(k), src, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), src, np.int32)), pa.array(idx), pa.array(np.full(len(k), shard, np.int32)), pa.array(k), pa.array(epoch.astype(np.int32))], schema=_SLOTS
                )


class Mix:
    """documents: row_id, src, source_size, target, size and start (the document's first word in its source; null without words), and keep.
    slots: src, idx (block), shard, slot, epoch. pieces: src, idx, row start, first and last word within the document."""

    def __init__(self, docs: DataFrame, keep: list[str], weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shards=SHARDS, source_col="source", text_col="text", hashes=None):
        """hashes: two 64-bit columns that together tell a row from all unlike ones, carried along as row1 and row2."""
        spark = docs.sparkSession
        rows = docs.select(
            *[F.col(c).alias(f"keep_{c}") for c in keep],
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(common.WORD)).cast("long").alias("size"),
            F.xxhash64(*keep, text_col).alias("tie"),
            *[h.alias(f"row{i}") for i, h in enumerate(hashes or [], 1)],
        ).withColumn("part", F.pmod("tie", F.lit(PARTS)).cast("int"))
        rows = common.materialize(rows, "sizes")
        totals = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
        if len(totals) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        totals.sort(key=lambda r: (r.source is None, r.source or ""))
        goal = targets([r.size for r in totals], weights, share, most)
        blocks = [-(-r.size // block) for r in totals]
        slots = []
        for r, t, n in zip(totals, goal, blocks, strict=True):
            whole, rest = divmod(t, r.size) if r.size else (0, 0)
            slots.append(int(min(most * n, whole * n + round(rest / block))))
        catalogue = spark.createDataFrame(
            [(r.source, i, r.size, t) for i, (r, t) in enumerate(zip(totals, goal, strict=True))], "source string, src int, source_size long, target double"
        )
        known = rows.join(F.broadcast(catalogue), rows.source.eqNullSafe(catalogue.source), "inner").drop(catalogue.source)
        per_part = known.groupBy("src", "part").agg(F.sum("size").alias("in_part"))
        before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        per_part = per_part.select("src", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
        within = Window.partitionBy("src", "part").orderBy("tie", "size", *[f"row{i}" for i, _ in enumerate(hashes or [], 1)]).rowsBetween(Window.unboundedPreceding, -1)
        self.documents = (
            known.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(per_part, ["src", "part"])
            .withColumn("start", F.when(F.col("size") > 0, F.col("part_start") + F.col("within")))
            .drop("within", "part_start", "part")
        )
        idx = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
        self.pieces = (
            self.documents.where("size > 0")
            .select("src", "start", "size", idx.alias("idx"))
            .select(
                "src",
                "idx",
                "start",
                F.greatest(F.col("idx") * block - F.col("start"), F.lit(0)).alias("first_word"),
                F.least((F.col("idx") + 1) * block - F.col("start"), F.col("size")).alias("end_word"),
            )
        )
        dealt, first = draw(slots, shards), np.zeros(len(slots), np.int64)
        counts = []
        for j, row in enumerate(dealt):
            counts += [(i, j, int(first[i]), int(row[i]), blocks[i]) for i in np.flatnonzero(row)]
            first += row
        counts = [(int(i), j, f, c, b) for i, j, f, c, b in counts]
        drawn = spark.createDataFrame(counts, "src int, shard int, first long, count long, blocks long")
        self.slots = drawn.repartition(max(1, min(len(counts), spark.sparkContext.defaultParallelism)), "src", "shard").mapInArrow(_deal, SLOTS_DDL)

    def placed(self) -> DataFrame:
        """Slots and the pieces of documents in their blocks, joined by index."""
        return self.slots.join(self.pieces.hint("merge"), ["src", "idx"])

    def taken(self) -> DataFrame:
        """documents with the words that the mix takes of each, repeats counted."""
        # From the few rows that slots are dealt out from, Spark would take this side for small; it grows with the data.
        uses = self.slots.groupBy("src", "idx").agg(F.count("*").alias("uses")).hint("merge")
        took = (
            self.pieces.join(uses, ["src", "idx"])
            .groupBy("src", "start")
            .agg(F.sum(F.col("uses") * (F.col("end_word") - F.col("first_word"))).alias("taken"))
            .hint("merge")
        )
        return self.documents.join(took, ["src", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(common.table(spark, sf_dir, "documents"), ["doc_id"])
    return mix.taken().select(F.col("keep_doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each epoch a row for every document of which the mix takes words, with these words as its text.

    Columns stay those of docs. What is taken whole keeps its text as it is; else the taken words are joined by spaces.
    n_chars, if there, is set to the new text's length. A row is found again by 128 bits over all its columns, so rows of one id and
    text under several sources each give their own. Of rows that are equal in all columns one stands for all."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashes = [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]
    mix = Mix(docs, ["doc_id"], hashes=hashes, **options)
    placed = mix.slots.select("src", "idx", "epoch").join(mix.pieces.hint("merge"), ["src", "idx"])
    runs = placed.groupBy("src", "start", "epoch").agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("_runs"))
    known = mix.documents.where("size > 0").select("src", "start", "row1", "row2", F.col("size").alias("_size"))
    runs = known.join(runs.hint("merge"), ["src", "start"]).select("row1", "row2", "_size", "_runs")
    # The input's row stays apart in a struct, so its columns may have any names.
    one = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("text"), hashes[0].alias("row1"), hashes[1].alias("row2"))
    if one.groupBy("row1", "row2").count().where("count > 1").select("row1").take(1):  # only then do whole rows have to be compared
        one = one.dropDuplicates(["row1", "row2"])
    out = one.join(runs.hint("merge"), ["row1", "row2"])
    whole = (F.size("_runs") > 0) & (F.expr("aggregate(_runs, 0L, (a, r) -> a + r.end_word - r.first_word)") == F.col("_size"))
    words = F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0))
    out = out.withColumn("_words", F.when(~whole, words))
    taken = F.expr("array_join(flatten(transform(_runs, r -> slice(_words, cast(r.first_word + 1 AS int), cast(r.end_word - r.first_word AS int)))), ' ')")
    out = out.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(taken))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
