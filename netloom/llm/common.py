"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.75

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where it is unset and driver and executors
    are one machine, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="netloom-")
            sc.setCheckpointDir(_own[sc.applicationId])
        base = _own[sc.applicationId]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/netloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: the lineage ends there, lost executors cost no
    recomputation, later reads take only the columns they need, and Spark knows the size."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialize() has written, once nothing reads them any more; the rest goes at exit. Shuffle files of ended jobs
    go when the driver's JVM collects its garbage, so that is asked for too."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for known in [k for k in _written if k[1].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]]:
                _written.remove(known)
                _delete(*known)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


@atexit.register
def release() -> None:
    """Deletes what materialize() has written. Only when no result that reads it is needed any more."""
    while _written:
        _delete(*_written.pop())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, name: str) -> np.ndarray:
    got = _tables.get(name)
    if got is None or len(got) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        got = np.ones(size, np.uint64)
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done < size:
                got[done : 2 * done] = got[: min(done, size - done)] * np.uint64(step)
                done, step = done * 2, step * step & _MASK
        _tables[name] = got
    return got[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes (lower-cased A-Z): a 64-bit hash, the first byte and the byte after the last, for each word.

    The hash is a polynomial of the word's bytes modulo 2**64, from differences of prefix sums, and then mixed."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw), "up"), out=sums[1:])
        value = (sums[end] - sums[start]) * _powers(_INVERSE, len(raw), "down")[start]
        value += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(value), start, end


def lowered_bytes(raw: bytes) -> np.ndarray:
    return _LOWER[np.frombuffer(raw, np.uint8)]


def lowered(text: str) -> np.ndarray:
    return lowered_bytes(text.encode("utf-8", "surrogatepass"))


def shingles_of(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A 64-bit hash for each run of width words, in order; with fewer words, one of the whole sequence; without words, none."""
    n = len(words)
    if not n:
        return words
    width_here = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width_here + 1, width_here, np.uint64)
        for i in range(width_here):
            out = out * np.uint64(0x9FB21C651E98DF25) + words[i : i + len(out)]
    return mix64(out)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, ascending; none for null and for texts without words."""
    return np.unique(shingles_of(words_of(lowered(text))[0])) if text else np.zeros(0, np.uint64)


def batches(rows, size: int = 256):
    """Record batches cut to at most size rows, so that work arrays stay small."""
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, so that further columns of any name cannot clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
