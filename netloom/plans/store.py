"""Written intermediate tables: they cut lineage, survive lost executors and give Spark sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; where it is unset and all is one machine, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="netloom-"))).rstrip("/")


#: Holds while a table is written. Files of long columns that hardly change unfold to some twenty times their size, so by their size alone Spark would
#: broadcast, by way of the driver, what doesn't fit there; and what a step has shuffled goes with its end, not when the driver next collects garbage.
WRITING = {"spark.sql.sources.fileCompressionFactor": "20", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _writing(spark: SparkSession):
    was = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, label: str) -> DataFrame:
    path = f"{folder(df.sparkSession)}/netloom/{label}-{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    with _writing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._netloom_path = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys, to as many tasks as a join has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def held(df: DataFrame, *keys: str) -> DataFrame:
    """df as dealt() by keys, in order and kept on the executors' disks: a loop that joins it by keys every round sends only the other side.
    To be let go by released() after the loop. Where a key is a literal, df must come from a written table, as Spark would deal it out without that key."""
    return df.sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def deleted(*tables: DataFrame) -> None:
    """Deletes tables, as written() returned them, that nothing reads any more. What is left goes at exit."""
    for df in tables:
        path = df._netloom_path
        if spark := _written.pop(path, None):
            _delete(spark, path)


def released(df: DataFrame) -> None:
    """Lets go of what held() has kept, and of the table below it, where it has one of its own."""
    df.unpersist()
    if hasattr(df, "_netloom_path"):
        deleted(df)


@atexit.register
def release() -> None:
    while _written:
        path, spark = _written.popitem()
        _delete(spark, path)
