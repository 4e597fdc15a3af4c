"""Expander decomposition: graphs are split along sweep cuts of low conductance until no part has one.

A lazy random walk from pseudorandom values, in whole numbers, brings the values of well-connected nodes together; each step is a join and a sum, for
all problems at once. A sweep puts values into bins and weighs the cut between each bin and the next: its edges over the lesser side's degrees.
Only bins, not nodes, are put in order, so a sweep has at most `BINS` rows a problem in one task.

Cases: loops count for nothing; parallel edges count each; nodes without edges are parts of their own; a part whose values are all equal has no cut;
ties go to the lower bin; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import dealt, deleted, held, released, written

BINS = 1024


def start_value(node):
    """The same 42-bit value for the same node id in any engine that has MD5."""
    return (F.conv(F.substring(F.md5(node.cast("string")), 1, 8), 16, 10).cast("bigint") - (1 << 31)) * 1024


def walked(edges: DataFrame, rounds: int) -> DataFrame:
    """problem_id, node_id, degree, x: after so many steps, in each of which a node's value becomes half its own and half its neighbours' mean.

    The arcs stay with their tails, so a step sends values, not arcs. A sum is taken in two halves that fit whole numbers of 64 bits: values have at most
    42 bits, so their upper halves add up without overflow to a degree of 2**42."""
    ends = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col(b).alias("to"))
    arcs = edges.where("src <> dst").select("problem_id", F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("a")).select("problem_id", "a.*")
    key = ["problem_id", "to"]
    arcs = held(dealt(arcs, *key).groupBy(*key, "node_id").agg(F.count("*").alias("w")), *key)
    # Every edge gives arcs both ways, so a node has as many behind it as ahead.
    now = written(arcs.groupBy("problem_id", F.col("to").alias("node_id")).agg(F.sum("w").alias("degree")).withColumn("x", start_value(F.col("node_id"))), "walk")
    for _ in range(rounds):
        around = arcs.join(now.select("problem_id", F.col("node_id").alias("to"), "x"), key)
        around = around.groupBy("problem_id", "node_id").agg(F.sum(F.shiftright("x", 21) * F.col("w")).alias("_up"), F.sum(F.col("x").bitwiseAND(F.lit((1 << 21) - 1)) * F.col("w")).alias("_low"))
        s = "CAST(_up AS DECIMAL(19,0)) * 2097152 + CAST(_low AS DECIMAL(19,0))"
        step = F.expr(f"CAST((CAST(x AS DECIMAL(19,0)) * CAST(degree AS DECIMAL(18,0)) + ({s})) DIV (2 * degree) AS BIGINT)")
        then = written(now.join(around, ["problem_id", "node_id"]).select("problem_id", "node_id", "degree", step.alias("x")), "walk")
        deleted(now)
        now = then
    released(arcs)
    return now


def sweep(values: DataFrame, edges: DataFrame, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """values with bin, and for each problem with a cut: problem_id, bin (the last on the cut's lower side), cut, volume of the lesser side, conductance."""
    span = values.groupBy("problem_id").agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    at = values.join(span, "problem_id").select("problem_id", "node_id", "degree", F.expr(f"(x - _low) * {bins} DIV (_high - _low + 1)").cast("int").alias("bin"))
    at = written(at, "bins")
    side = lambda c, n: at.select("problem_id", F.col("node_id").alias(c), F.col("bin").alias(n))
    across = edges.select("problem_id", "src", "dst").where("src <> dst").join(side("src", "a"), ["problem_id", "src"]).join(side("dst", "b"), ["problem_id", "dst"]).where("a <> b")
    opens = across.select("problem_id", F.explode(F.array(F.struct(F.least("a", "b").alias("bin"), F.lit(1).alias("d")), F.struct(F.greatest("a", "b").alias("bin"), F.lit(-1).alias("d")))).alias("e"))
    change = opens.groupBy("problem_id", F.col("e.bin").alias("bin")).agg(F.sum("e.d").alias("d"))
    volume = at.groupBy("problem_id", "bin").agg(F.sum("degree").alias("v"))
    upto = Window.partitionBy("problem_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = volume.join(change, ["problem_id", "bin"], "left").select("problem_id", "bin", F.sum(F.coalesce("d", F.lit(0))).over(upto).alias("cut"), F.sum("v").over(upto).alias("v"), F.sum("v").over(Window.partitionBy("problem_id")).alias("total"))
    rows = rows.where("v < total").withColumn("volume", F.least(F.col("v"), F.col("total") - F.col("v"))).withColumn("conductance", F.col("cut") / F.col("volume"))
    best = rows.groupBy("problem_id").agg(F.min(F.struct("conductance", "bin", "cut", "volume")).alias("b"))
    return at, best.select("problem_id", "b.bin", "b.cut", "b.volume", "b.conductance")


def decompose(nodes: DataFrame, edges: DataFrame, least: float = 0.1, rounds: int = 16, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """problem_id, node_id, part: no part has a sweep cut of a conductance below least; and problem_id, edge_id of the edges between parts.

    All parts that still have one are split at once; of a split, each side goes on for itself. At most `most` such levels."""
    part = written(nodes.select("problem_id", "node_id").distinct().withColumn("part", F.lit("0")), "parts")
    name = lambda p: F.to_json(F.struct(F.col("problem_id"), p))
    open_, level = edges.select("problem_id", "edge_id", "src", "dst").withColumn("part", F.lit("0")), 0
    between = []
    while level < most:
        inner = written(open_.select(name(F.col("part")).alias("problem_id"), "edge_id", "src", "dst"), "part-edges")
        at, cuts = sweep(walked(inner, rounds), inner)
        cuts = written(cuts.where(F.col("conductance") < least).select("problem_id", F.col("bin").alias("_cut")), "part-cuts")
        if not cuts.take(1):
            break
        sides = written(at.join(cuts, "problem_id").select(F.col("problem_id").alias("_name"), "node_id", F.when(F.col("bin") <= F.col("_cut"), "0").otherwise("1").alias("_side")), "sides")
        then = part.withColumn("_name", name(F.col("part"))).join(sides, ["_name", "node_id"], "left")
        part = written(then.select("problem_id", "node_id", F.concat_ws("", "part", "_side").alias("part")), "parts")
        # Only parts that have just been split can have a new cut.
        split = cuts.select(F.col("problem_id").alias("_name"))
        mine = open_.withColumn("_name", name(F.col("part"))).join(split, "_name", "left_semi")
        end = lambda c, n: part.select("problem_id", F.col("node_id").alias(c), F.col("part").alias(n))  # noqa: B023, E731
        mine = mine.drop("part", "_name").join(end("src", "_a"), ["problem_id", "src"]).join(end("dst", "_b"), ["problem_id", "dst"])
        mine = written(mine, "split-edges")
        between.append(mine.where("_a <> _b").select("problem_id", "edge_id"))
        open_, level = mine.where("_a = _b").select("problem_id", "edge_id", "src", "dst", F.col("_a").alias("part")), level + 1
    none = edges.select("problem_id", "edge_id").limit(0)
    for more in between:
        none = none.unionByName(more)
    return part, none
