"""Approximate nearest neighbours: Low-dimensional stable projections indexed by kd-tree.

Unit vectors are projected by a few normally distributed directions, so that a squared projected distance is the squared
distance times a chi-square variable. A kd-tree over the projections gives candidates by growing projected distance, which
are verified on the original vectors, until the chi-square test holds: a vector nearer than the k-th found would, with
probability STOP, have come already.

Rows are dealt out to blocks by a hash, and each block of queries meets each block of rows; both are of bounded size. Of
equal vectors only the k + 1 smallest ids take part, as no others can be among the k nearest; so a group of copies of any
size costs no more than k + 1 rows.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id;
vectors meet those of their length only; rows with the query's id are its own; with fewer candidates than k all come;
an empty table gives no rows; further columns are not read. Rows
that repeat both id and vector count once. A very long vector is one row like any other; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEAREST, QUERY_EVERY = 5, 50
PROJECTED, STOP = 8, 0.99
LEAF = 48
#: Rows and queries of a block at most, about.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_ROWS = 65_536, 16_384, 4_096

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def chi_square(x: float, m: int = PROJECTED) -> float:
    """The distribution function of chi-square with an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    if half > 700:
        return 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


#: The least x at which chi_square(x) reaches STOP.
def _limit(p: float, m: int = PROJECTED) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


class Tree:
    """A kd-tree over projected points; nodes hold their boxes, leaves their points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.sons, self.members = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)] if len(points) else []
        while todo:
            of, parent, side = todo.pop()
            here, part = len(self.low), points[of]
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.sons.append([-1, -1])
            self.members.append(None)
            if parent >= 0:
                self.sons[parent][side] = here
            wide = int((high - low).argmax())
            if len(of) <= leaf or high[wide] == low[wide]:
                self.members[here] = of
                continue
            order = np.argpartition(part[:, wide], len(of) // 2)
            todo += [(of[order[: len(of) // 2]], here, 0), (of[order[len(of) // 2 :]], here, 1)]
        if self.low:
            self.low, self.high = np.stack(self.low), np.stack(self.high)

    def leaves(self, q: np.ndarray):
        """Squared distance from the query to the box, and members, of leaves by growing distance."""
        if not len(self.low):
            return
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        far = (gap * gap).sum(1).tolist()
        heap = [(far[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.members[node] is not None:
                yield d, self.members[node]
            else:
                for son in self.sons[node]:
                    heapq.heappush(heap, (far[son], son))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.abs(x).max(1, keepdims=True)  # first, so that no square over- or underflows
    x = x / top
    norm = np.sqrt((x * x).sum(1))
    return x / norm[:, None], norm * top[:, 0]


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, stop: float = STOP):
    """Yields (query id, ids, cosines) of the nearest found of one block."""
    directions = np.random.Generator(np.random.PCG64(vectors.shape[1])).standard_normal((vectors.shape[1], PROJECTED))
    unit, _ = _unit(vectors)
    asked, _ = _unit(queries)
    tree, projected, limit = Tree(unit @ directions), asked @ directions, _limit(stop)
    for q, u, p in zip(query_ids.tolist(), asked, projected, strict=True):
        near_ids, near = np.zeros(0, np.int64), np.zeros(0)
        worst = math.inf
        for d, members in tree.leaves(p):
            if d > 1e-9 and d >= limit * worst:
                break
            cosine = (unit[members] * u).sum(1)
            own = ids[members] != q
            near_ids, near = np.concatenate([near_ids, ids[members][own]]), np.concatenate([near, cosine[own]])
            if len(near) > k:
                best = np.lexsort((near_ids, -near))[:k]
                near_ids, near = near_ids[best], near[best]
            if len(near) >= k:
                worst = max(0.0, 2 - 2 * near.min())
        yield q, near_ids, near


def _block(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            grid = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
            x, y = grid(rows), grid(asked)
            for q, ids, score in search(rows.column("id").to_numpy(), x, asked.column("id").to_numpy(), y, k):
                out += [(q, i, s) for i, s in zip(ids.tolist(), score.tolist(), strict=True)]
        return pa.Table.from_batches([common.arrow(_FOUND, **dict(zip(_FOUND.names, zip(*out, strict=True) if out else ([], [], []), strict=True)))])

    return run


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row for which the condition on the column id holds."""
    spark = vectors.sparkSession
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = common.materialize(rows.withColumn("dim", F.size("v")), "vectors")
    n = rows.count()
    asking = rows.where(is_query(F.col("id")))
    n_asking = asking.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    query_blocks = max(1, -(-n_asking // BLOCK_QUERIES))
    # Spark applies the limit before the shuffle too, so that no task gets a whole group of copies.
    few = rows.dropDuplicates(["id", "v"]).withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1).drop("copy")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    few = few.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("query_block", each(query_blocks))
    asking = asking.dropDuplicates(["id", "v"]).withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("block", each(blocks))
    keys = ["block", "query_block", "dim"]
    found = few.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_block(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), lambda i: i % QUERY_EVERY == 0)
