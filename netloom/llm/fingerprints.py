"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the K smallest distinct hashes of a document's five-word shingles. Sketches of parts merge into the sketch of
the whole; they estimate resemblance, containment and the number of distinct shingles. A sketch of fewer than K hashes
holds all of them, and its answers are exact.

Likeness: of two sketches, the share of the K smallest hashes of their union that both have. Of two documents without
shingles it is 1, of one without and one with shingles 0.

The edited text of a document needs the beginning of the next one, by descending id. One shuffle ranges whole texts by id;
each range is read in order with one document held at a time, and only the first and last documents of ranges meet
again, to edit across their borders.

Cases: a null text is empty; rows of equal ids follow each other by a hash of the text; null ids come last; a single
document is its own next; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 256
#: Characters of a range of documents, about.
RANGE_CHARS = 64_000_000

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending."""
    hashes = common.shingles_of(common.words_of(common.lowered(text))[0]) if text else np.zeros(0, np.uint64)
    if len(hashes) > 4 * k:  # repeats are rare, so that a few more than k suffice; else all are sorted
        small = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(small) >= k:
            return small[:k]
    return np.unique(hashes)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a document from those of its parts, or of a union of documents."""
    return np.unique(np.concatenate(sketches))[:k]


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k=k), k)
    return min(1.0, both / distinct(a, k))


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _row(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    new = edited(text, following)
    edit = own if new == text else sketch(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(own), encode(edit), resemblance(own, edit), resemblance(own, other))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return common.arrow(_OUT, **dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)))


def _in_order(rows):
    """Documents in order, each range with the first text of the next range behind its last document (marked as border)."""
    held = None
    for batch in common.batches(rows):
        out = []
        for doc_id, text, border in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            own = sketch(text)
            if held is not None:
                out.append(_row(*held, text, own))
            held = None if border else (doc_id, text, own)
        if out:
            yield _batch(out)


def _first_ids(rows):
    for batch in rows:
        if batch.num_rows:
            yield batch.slice(0, 1)
            break


def ranges_of(rows: DataFrame, count: int) -> list[int]:
    """Ids, descending, at which ranges of about equally many rows begin; they come from ids alone."""
    ids = rows.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(count, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"))
    return sorted({r.doc_id for r in ids.mapInArrow(_first_ids, "doc_id long").collect()}, reverse=True)


def fingerprints(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    spark, rows = docs.sparkSession, common.documents_of(docs)
    total = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    count = max(1, -(-total // range_chars), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20))
    heads = ranges_of(rows, count)
    starts = spark.sparkContext.broadcast(-np.array(heads, np.int64))  # one id for each range

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(starts.value, -ids.fillna(0).to_numpy(np.int64), side="right") - 1
        return pd.Series(np.where(ids.isna(), len(starts.value), found).astype(np.int32))

    order = F.xxhash64("text")
    # The first row of each range, the null ids last: one text a range, which the previous range needs behind its last.
    first = F.min_by("text", order).alias("text")
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(heads)], "doc_id long, range int")
    opening = rows.join(F.broadcast(wanted), "doc_id").groupBy("range").agg(first)
    nameless = rows.where("doc_id IS NULL").groupBy(F.lit(len(heads)).alias("range")).agg(first)
    opening = common.materialize(opening.unionByName(nameless), "opening")
    n = opening.agg(F.max("range").alias("n")).first().n
    if n is None:
        return spark.createDataFrame([], OUT_DDL)
    lowest = 0 if heads else n  # with null ids alone, they are the only range
    behind = F.when(F.col("range") == lowest, F.lit(n)).otherwise(F.col("range") - 1).cast("int")
    borders = opening.select(F.lit(None).cast("long").alias("doc_id"), "text", behind.alias("range"), F.lit(True).alias("border"))
    dealt = rows.withColumn("range", range_of("doc_id")).withColumn("border", F.lit(False)).unionByName(borders)
    placed = dealt.repartitionById(n + 1, F.col("range")).sortWithinPartitions("range", "border", F.desc_nulls_last("doc_id"), order)
    return placed.select("doc_id", "text", "border").mapInArrow(_in_order, OUT_DDL)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
