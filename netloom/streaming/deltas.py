"""Edge deltas: merged into edge tables, and only the problems that they touch are solved again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.solve import Solution, solve
from ..plans.problem import Options
from ..plans.store import written

COLUMNS = ["problem_id", "edge_id", "src", "dst", "lower", "upper", "cost"]


def merge(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """edges after deltas (their columns, op: upsert or delete, and seq): the last delta of an edge holds; of several with one seq an upsert,
    and of these the greatest values."""
    last = Window.partitionBy("problem_id", "edge_id").orderBy(F.desc("seq"), F.desc("op"), *[F.desc(c) for c in COLUMNS[2:]])
    final = deltas.withColumn("_k", F.row_number().over(last)).where("_k = 1")
    kept = edges.select(*COLUMNS).join(final.select("problem_id", "edge_id"), ["problem_id", "edge_id"], "left_anti")
    return kept.unionByName(final.where("op = 'upsert'").select(*COLUMNS))


def resolve(nodes: DataFrame, edges: DataFrame, deltas: DataFrame, options: Options = Options()) -> tuple[DataFrame, Solution]:
    """The merged edges, and solutions of the problems with deltas alone."""
    merged = written(merge(edges, deltas), "edges")
    touched = deltas.select("problem_id").distinct()
    return merged, solve(nodes.join(touched, "problem_id", "left_semi"), merged.join(touched, "problem_id", "left_semi"), options)


def batches_of(nodes: DataFrame, edges: DataFrame, sink: Callable[[int, Solution], None], options: Options = Options()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of deltas: sink gets each batch's number and solution. State is the merged edge table."""
    state = {"edges": edges, "done": -1}

    def each(batch: DataFrame, number: int) -> None:
        if number <= state["done"] or batch.isEmpty():  # a batch that comes again has been merged
            return
        state["edges"], solution = resolve(nodes, state["edges"], batch, options)
        state["done"] = number
        sink(number, solution)

    return each


class EdgeState:
    """Edges under batches of deltas, kept in a folder that all machines see, so that a stream goes on after a restart of its driver.

    A batch writes, under its number, all edges of the problems it touches, and for each of them a row without an edge, which stands for
    problems that have lost all edges. A problem's edges are those of the last batch that touched it. Every so many batches all are written as
    a snapshot. A batch reads only what earlier numbers wrote, so one that comes again after a failure does the same again, and
    folders whose write was not finished don't count."""

    def __init__(self, spark: SparkSession, path: str, edges: DataFrame, every: int = 50):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        if not self._numbers("snapshot", 0):
            self._snapshot(edges.select(*COLUMNS), -1)

    def _numbers(self, kind: str, below: int) -> list[int]:
        """Batches before this one of which something is wholly written, ascending."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(n for n in (int(f.getPath().getParent().getName().split("=")[1]) for f in found) if n < below)

    def _write(self, df: DataFrame, kind: str, number: int) -> DataFrame:
        path = f"{self.path}/{kind}/batch={number}"
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _snapshot(self, edges: DataFrame, number: int) -> None:
        self._write(edges.select(*COLUMNS), "snapshot", number)

    def edges(self, below: int, problems: DataFrame | None = None) -> DataFrame:
        """The edges, of these problems or of all, before the batch of this number."""
        last = self._numbers("snapshot", below)[-1]
        read = lambda kind, n: self.spark.read.parquet(f"{self.path}/{kind}/batch={n}").select(*COLUMNS, F.lit(n).alias("_n"))
        parts = [read("snapshot", last), *(read("touched", n) for n in self._numbers("touched", below) if n > last)]
        if problems is not None:
            parts = [p.join(problems, "problem_id", "left_semi") for p in parts]
        held = reduce(DataFrame.unionByName, parts)
        newest = held.groupBy("problem_id").agg(F.max("_n").alias("_n"))
        return held.join(newest, ["problem_id", "_n"], "left_semi").where("edge_id IS NOT NULL").select(*COLUMNS)

    def apply(self, batch: DataFrame, number: int) -> DataFrame:
        """Merges a batch and returns all edges of the problems that it touches."""
        touched = batch.select("problem_id").distinct()
        none = [F.lit(None).cast("bigint").alias(c) for c in COLUMNS[1:]]
        merged = merge(self.edges(number, touched), batch).unionByName(touched.select("problem_id", *none))
        merged = self._write(merged, "touched", number)
        if (number + 1) % self.every == 0:
            self._snapshot(self.edges(number + 1), number)
        return merged.where("edge_id IS NOT NULL")


def durable_batches_of(nodes: DataFrame, edges: DataFrame, path: str, sink: Callable[[int, Solution], None], options: Options = Options(), every: int = 50) -> Callable[[DataFrame, int], None]:
    """As batches_of, with the state in the folder path. edges count only where the folder holds none yet. A restarted stream gives a batch of which it
    doesn't know whether it was done once more, so sink may get a number twice, with the same solution."""
    state = EdgeState(edges.sparkSession, path, edges, every)

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        mine = state.apply(batch, number)
        touched = batch.select("problem_id").distinct()
        sink(number, solve(nodes.join(touched, "problem_id", "left_semi"), mine, options))

    return each


def rebuild_levels(n: int) -> list[int]:
    """Update counts after which each level of a structure over n items is rebuilt: powers of two up to n."""
    return [1 << i for i in range(max(1, n).bit_length())]


def chunked(deltas: DataFrame, most: int) -> DataFrame:
    """Deltas with chunk, so that none has more than most of one problem."""
    return deltas.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("problem_id").orderBy("seq")) - 1) / most))
