"""Every query of the flow engine against the same result in SQL."""

import math

import duckdb
import pytest

from netloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def folder(name):
    """In the smallest tables two lines share an edge id."""
    return "/root/testdata/sf0.01" if name.endswith("_lines") else "/root/testdata/sf0.001"


def connect(name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder(name)}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, folder(name))
    got = rows(df.columns, map(tuple, df.collect()))
    cur = connect(name).execute(queries.SQL[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) for x, y in zip(a, b)), (a, b)


def test_halves_of_a_size_go_to_the_even_neighbour(spark, tmp_path):
    values = [0.5, 1.5, 2.5, 9.5, 10.5, 99.5, 100.5, 0.49, 0.51]
    spark.createDataFrame([(i, "click", v) for i, v in enumerate(values)], "event_id bigint, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES["game_pressure_events"](spark, str(tmp_path))
    cur = duckdb.connect()
    cur.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur.execute(queries.SQL["game_pressure_events"])
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
