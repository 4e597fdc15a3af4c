"""The data model: problems as two tables, their options, and the checks that a problem must pass.

nodes: problem_id, node_id, demand (positive: net inflow required). edges: problem_id, edge_id, src, dst, lower, upper, cost.
Parallel edges are told apart by edge_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "problem_id string, node_id bigint, demand bigint"
EDGES = "problem_id string, edge_id bigint, src bigint, dst bigint, lower bigint, upper bigint, cost bigint"

STRATEGIES = ("full_dynamic", "periodic_rebuild")
ORACLES = ("dynamic", "fallback", "hybrid")


@dataclass(frozen=True)
class Options:
    """Options of a solve. Results are exact and deterministic whatever they say; limits raise or mark a problem."""

    strategy: str = "full_dynamic"
    oracle_mode: str = "dynamic"
    rebuild_every: int = 25
    max_augmentations: int | None = None
    time_limit_s: float | None = None
    gap_exponent: float = 10.0
    gap_tolerance: float | None = None
    alpha: float | None = None
    approx_factor: float = 0.1
    seed: int = 0
    raise_on_error: bool = False
    on_fraction: str = "error"

    def __post_init__(self):
        checks = {
            "strategy": self.strategy in STRATEGIES,
            "oracle_mode": self.oracle_mode in ORACLES,
            "rebuild_every": self.rebuild_every > 0,
            "gap_exponent": self.gap_exponent > 0,
            "gap_tolerance": self.gap_tolerance is None or self.gap_tolerance > 0,
            "alpha": self.alpha is None or self.alpha > 0,
            "approx_factor": self.approx_factor >= 0,
            "on_fraction": self.on_fraction in ("error", "truncate"),
        }
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ValueError(f"out of range: {', '.join(bad)}")


def whole(column: Column, options: Options) -> Column:
    """A whole number; a fraction is an error, or loses its fraction if the options say so."""
    if options.on_fraction == "truncate":
        return column.cast("bigint")
    return F.when(column.cast("double") == F.floor(column.cast("double")), column.cast("bigint")).otherwise(F.raise_error(F.lit("a fraction where a whole number is needed")).cast("bigint"))


def from_edges(df: DataFrame, src="src", dst="dst", capacity="capacity", lower=None, weight=None, cost=None, edge_id=None, problem_id=None, options=Options()) -> DataFrame:
    """An edge table from any table by the names of its columns: cost is the weight, else the cost, else 0; lower is 0 if missing."""
    zero = F.lit(0)
    price = F.coalesce(*[F.col(c) for c in (weight, cost) if c], zero)
    return df.select(
        (F.col(problem_id).cast("string") if problem_id else F.lit("0")).alias("problem_id"),
        (F.col(edge_id).cast("bigint") if edge_id else F.monotonically_increasing_id()).alias("edge_id"),
        F.col(src).cast("bigint").alias("src"),
        F.col(dst).cast("bigint").alias("dst"),
        whole(F.coalesce(F.col(lower), zero) if lower else zero, options).alias("lower"),
        whole(F.col(capacity), options).alias("upper"),
        whole(price, options).alias("cost"),
    )


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem_id, rule, key of everything that makes a problem invalid."""
    say = lambda df, rule, key: df.select("problem_id", F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    ends = edges.select("problem_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    sums = nodes.groupBy("problem_id").agg(F.sum(F.col("demand").cast("decimal(38,0)")).alias("total"))
    twice = lambda df, key: df.groupBy("problem_id", key).count().where("count > 1")
    return (
        say(ends.join(nodes, ["problem_id", "node_id"], "left_anti"), "endpoint without node", "node_id")
        .unionByName(say(sums.where("total <> 0"), "demands do not sum to zero", "total"))
        .unionByName(say(edges.where("lower > upper"), "lower above upper", "edge_id"))
        .unionByName(say(edges.where("upper IS NULL"), "no finite capacity", "edge_id"))
        .unionByName(say(edges.where("lower IS NULL OR cost IS NULL"), "no finite lower bound or cost", "edge_id"))
        .unionByName(say(nodes.where("demand IS NULL"), "no finite demand", "node_id"))
        .unionByName(say(twice(nodes, "node_id"), "duplicate node", "node_id"))
        .unionByName(say(twice(edges, "edge_id"), "duplicate edge", "edge_id"))
    )


def dense_ids(nodes: DataFrame) -> DataFrame:
    """node_id and index, from 0 in the order of ids, for each problem."""
    from pyspark.sql import Window

    return nodes.withColumn("index", (F.row_number().over(Window.partitionBy("problem_id").orderBy("node_id")) - 1).cast("bigint"))
