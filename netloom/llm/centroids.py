"""Centroid clustering: exact integer k-means with block-norm screening.

Vectors become integers once, v = 2^`BITS` q + r. The compressed form of a vector is q with two norms for each segment of
`SEGMENT` components: the squared norm of q_s, and the norm of the remainder r_s rounded up. For a centroid c let a_s be the norm of
2^BITS q_s - c_s, which comes from the segment norms and one product of the compressed vectors with the centroids. By
Cauchy-Schwarz, |v - c|^2 >= sum over segments of max(0, a_s - |r_s|)^2. A vector meets the centroid of the least bound first; of the
others, only those whose bound isn't above the best distance so far get an exact integer distance. Bounds are rounded down, so
the assignment is that of an exhaustive search, ties included.

A round is one pass over the written vectors: tasks send a row of sums for each centroid, and only their totals and the new
centroids, whose size doesn't depend on the data, pass through the driver.

Cases: vectors that are null, of another length, or holding null or non-finite components take no part; repeated rows are vectors of
their own, as are null ids, which come last in the choice of centroids; ties go to the smaller number; with fewer than k vectors
there are as many centroids as vectors; an empty table gives no rows; a component beyond `LARGEST` in size after scaling has no 64-bit
distance and raises an error; further columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components of a segment, and low bits that compressed vectors lack.
SEGMENT, BITS = 8, 3
#: Beyond this size of a component, products of segments may not be exact in double precision.
LARGEST = 1 << 24
#: Vectors that are worked on at once.
AT_ONCE = 4096


def by_segment(v: np.ndarray, segment: int) -> np.ndarray:
    """Rows cut into segments, the last filled up with zeros: segments x rows x components."""
    n, dimensions = v.shape
    filled = np.zeros((n, -(-dimensions // segment) * segment), np.float64)
    filled[:, :dimensions] = v
    return filled.reshape(n, -1, segment).transpose(1, 0, 2)


def compress(v: np.ndarray, segment: int = SEGMENT, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q, the squared norm of each segment of q, and the norm of each segment of the remainder, rounded up."""
    q = (v + (1 << bits >> 1)) >> bits
    rest = np.ceil(np.sqrt((by_segment(v - (q << bits), segment) ** 2).sum(2).T) * (1 + 1e-12))
    return q, (by_segment(q, segment) ** 2).sum(2).T.astype(np.int64), rest.astype(np.int64)


def bounds(q: np.ndarray, norms: np.ndarray, rest: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT, bits: int = BITS) -> np.ndarray:
    """At most the squared distance of each vector and each centroid."""
    c, step = by_segment(centroids, segment), float(1 << bits)
    products = by_segment(q, segment) @ c.transpose(0, 2, 1)
    squares = step * step * norms.T[:, :, None] + (c**2).sum(2)[:, None, :] - 2 * step * products  # whole numbers below 2^53
    apart = np.maximum(np.sqrt(np.maximum(squares, 0)) - rest.T[:, :, None], 0)
    return np.floor((apart**2).sum(0) * (1 - 1e-9)).astype(np.int64)


def nearest(v: np.ndarray, low: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector, the squared distance, and how many exact distances that took. low: bounds()."""
    first = low.argmin(1)
    away = v - centroids[first]
    best, at, taken = (away * away).sum(1), first.copy(), len(v)
    for c in range(len(centroids)):
        open_ = np.flatnonzero((low[:, c] <= best) & (first != c))
        taken += len(open_)
        away = v[open_] - centroids[c]
        exact = (away * away).sum(1)
        nearer = (exact < best[open_]) | (exact == best[open_]) & (c < at[open_])
        best[open_[nearer]], at[open_[nearer]] = exact[nearer], c
    return at, best, taken


@dataclass
class Clustering:
    #: vec_id, cluster, distance.
    assigned: DataFrame
    #: One row of integers for each centroid.
    centroids: np.ndarray
    #: Exact distances of the last assignment, and how many an exhaustive search takes.
    exact: int
    pairs: int


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: array<bigint> of floor(scale * x) of the vectors that take part."""
    e = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    whole = (F.size("e") == dimensions) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    v = e.where(whole).select("vec_id", F.transform("e", lambda x: F.floor(scale * F.when(F.abs(x) <= 4.0 * LARGEST, x).otherwise(4.0 * LARGEST))).alias("v"))
    return v.select("vec_id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit distances"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose sha256 of "seed:vec_id" is least, in that order; vectors of one id by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimensions).astype(np.int64)


_HELD = "vec_id long, v array<int>, q array<int>, norms array<long>, rest array<long>"


def _compress(dimensions: int, segment: int, bits: int):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("q", pa.list_(pa.int32())), ("norms", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64()))])

    def run(rows):
        for batch in common.batches(rows, AT_ONCE):
            q, norms, rest = compress(_matrix(batch.column(1), dimensions), segment, bits)
            yield common.arrow(schema, vec_id=batch.column(0), v=batch.column(1).cast(pa.list_(pa.int32())), q=list(q), norms=list(norms), rest=list(rest))

    return run


def compressed(vectors: DataFrame, dimensions: int = DIMENSIONS, segment: int = SEGMENT, bits: int = BITS) -> DataFrame:
    """vec_id, v and its compressed form."""
    return vectors.select("vec_id", "v").mapInArrow(_compress(dimensions, segment, bits), _HELD)


def _assign(centroids: np.ndarray, segment: int, bits: int, sums: bool):
    k, dimensions = centroids.shape
    segments = -(-dimensions // segment)
    totals = pa.schema([("cluster", pa.int32()), ("total", pa.list_(pa.int64()))])
    rows_of = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("exact", pa.int64())])

    def run(rows):
        n, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in common.batches(rows, AT_ONCE):
            v = _matrix(batch.column(1), dimensions)
            low = bounds(_matrix(batch.column(2), dimensions), _matrix(batch.column(3), segments), _matrix(batch.column(4), segments), centroids, segment, bits)
            at, distance, taken = nearest(v, low, centroids)
            if sums:
                n += np.bincount(at, minlength=k)
                np.add.at(total, at, v)
            else:
                yield common.arrow(rows_of, vec_id=batch.column(0), cluster=at, distance=distance, exact=[taken] + [0] * (len(v) - 1))
        if sums:
            yield common.arrow(totals, cluster=np.arange(k), total=list(np.hstack((total, n[:, None]))))

    return run


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, segment: int = SEGMENT, bits: int = BITS, seed: int = SEED) -> Clustering:
    """vectors: vec_id, v: array<bigint>. Each round assigns all vectors and replaces every non-empty centroid by the floored mean."""
    held = common.materialize(compressed(vectors, dimensions, segment, bits), "vectors")
    centroids = first_centroids(held, k, seed)
    if not len(centroids):
        empty = held.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(empty, centroids, 0, 0)
    for _ in range(rounds):
        sums = held.mapInArrow(_assign(centroids, segment, bits, True), "cluster int, total array<long>")
        by_place = sums.select("cluster", F.posexplode("total").alias("j", "x")).groupBy("cluster", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        totals = {(r.cluster, r.j): int(r.x) for r in by_place.collect()}  # k * (dimensions + 1) rows
        for c in range(len(centroids)):
            if n := totals.get((c, dimensions), 0):
                centroids[c] = [totals[c, j] // n for j in range(dimensions)]
    assigned = held.mapInArrow(_assign(centroids, segment, bits, False), "vec_id long, cluster int, distance long, exact long")
    assigned = common.materialize(assigned, "clusters")
    seen = assigned.agg(F.sum("exact"), F.count("*")).first()
    common.drop(held)
    return Clustering(assigned.drop("exact"), centroids, seen[0] or 0, seen[1] * len(centroids))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(integers(common.table(spark, sf_dir, "embeddings")))
    inertia = {r.cluster: int(r.total) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digest)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) AS i, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "x AS MATERIALIZED (SELECT i, j, CAST(floor(1024 * CAST(e[j] AS DOUBLE)) AS BIGINT) AS x FROM v, range(1, 65) AS r(j))",
        "c0 AS MATERIALIZED (SELECT i - 1 AS c, j, x AS m FROM x WHERE i <= 8)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT i, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS d FROM x JOIN c{k} USING (j) GROUP BY i, c)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT i, s.c AS c, s.d AS d FROM (SELECT i, min({{'d': d, 'c': c}}) AS s FROM d{k} GROUP BY i))")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM x JOIN a{k} USING (i) GROUP BY c, j)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, j, CASE WHEN n IS NULL THEN m ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS m FROM c{k} LEFT JOIN s{k} USING (c, j))")
    return (
        f"WITH {', '.join(steps)}, h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY c) "
        "SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 "
        f"FROM a{ROUNDS} JOIN v USING (i) JOIN h USING (c)"
    )


CENTROIDS_SQL = _sql()
