"""Every query of the library against the SQL that should give the same rows, run by another engine."""

import math

import duckdb
import pytest

from laminara.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return v if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    cols = sorted(names)
    rows = lambda rs: sorted((tuple(plain(r[c]) for c in cols) for r in rs), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_plans_avoid_nested_loops(spark, sf):
    """Pairs and radius joins are hash or sort-merge joins."""
    for name in ("jon_pairs", "agg_consensus", "jon_box_overlaps", "jon_tile_neighbours"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
