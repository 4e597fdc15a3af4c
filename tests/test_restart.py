"""Edge state that outlives the driver of a stream."""

import pytest

from netloom.operators.solve import solve
from netloom.streaming import deltas

NODE, EDGE = "problem_id string, node_id bigint, demand bigint", "problem_id string, edge_id bigint, src bigint, dst bigint, lower bigint, upper bigint, cost bigint"
DELTA = EDGE + ", op string, seq bigint"


@pytest.fixture
def tables(spark):
    nodes = spark.createDataFrame([(p, v, d) for p in "abc" for v, d in ((0, -2), (1, 2))], NODE)
    edges = spark.createDataFrame([(p, 1, 0, 1, 0, 5, 10) for p in "abc"], EDGE)
    return nodes, edges


BATCHES = [
    [("a", 2, 0, 1, 0, 5, 3, "upsert", 1), ("b", 1, 0, 1, 0, 5, 7, "upsert", 2)],
    [("a", 2, 0, 1, 0, 5, 1, "upsert", 3), ("c", 1, None, None, None, None, None, "delete", 4)],
    [("b", 3, 0, 1, 0, 1, 2, "upsert", 5), ("b", 3, 0, 1, 0, 1, 4, "upsert", 5)],
]


def run(stream_folder, spark, tables, path, sink, every):
    source = spark.readStream.schema(DELTA).parquet(f"{stream_folder}/in")
    each = deltas.durable_batches_of(*tables, path, sink, every=every)
    query = source.writeStream.foreachBatch(each).option("checkpointLocation", f"{stream_folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(300)
    query.stop()


@pytest.mark.parametrize("every", [2, 50])
def test_stop_and_resume(spark, tables, tmp_path, every):
    """After each batch the stream, its state and its sink are thrown away; the next run finds all earlier deltas in the folder."""
    costs, path = {}, f"file://{tmp_path}/state"
    table = tables[1]
    for rows in BATCHES:
        batch = spark.createDataFrame(rows, DELTA)
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(tmp_path, spark, tables, path, lambda n, s: costs.update({r.problem_id: (r.status, r.cost) for r in s.solutions.collect()}), every)
        table = deltas.merge(table, batch)
    want = {r.problem_id: (r.status, r.cost) for r in solve(tables[0], table).solutions.collect()}
    assert costs == want and want["c"][0] == "INFEASIBLE" and want["a"] == ("OPTIMAL", 2)
    state = deltas.EdgeState(spark, path, tables[1], every)
    assert sorted(state.edges(99).collect()) == sorted(table.select(*deltas.COLUMNS).collect())


def test_a_batch_that_failed_comes_again(spark, tables, tmp_path):
    path, seen = f"file://{tmp_path}/state", []
    batch = spark.createDataFrame(BATCHES[0], DELTA)
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")

    def fails(n, s):
        raise RuntimeError("sink")

    with pytest.raises(Exception, match="sink"):
        run(tmp_path, spark, tables, path, fails, 50)
    run(tmp_path, spark, tables, path, lambda n, s: seen.append((n, sorted((r.problem_id, r.cost) for r in s.solutions.collect()))), 50)
    assert seen == [(0, [("a", 6), ("b", 14)])]


def test_equal_seq_is_no_matter_of_chance(spark, tables):
    rows = BATCHES[2] + [("b", 3, None, None, None, None, None, "delete", 5)]
    for order in (rows, rows[::-1]):
        got = deltas.merge(tables[1], spark.createDataFrame(order, DELTA)).where("edge_id = 3").collect()
        assert [(r.upper, r.cost) for r in got] == [(1, 4)]
