"""Every query with an oracle against DuckDB on the small tables."""

import os

import pytest

from eventscore.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def plain(rows):
    return sorted(tuple("null" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    out = QUERIES[name](spark, DIR)
    cols = sorted(out.columns)
    want = duck.sql(ORACLES[name])
    assert cols == sorted(want.columns)
    assert plain(out.select(*cols).collect()) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """What no SQL expresses is executed; its operators are held against brute force in the other tests."""
    out = QUERIES[name](spark, DIR)
    rows = out.collect()
    assert rows and all(len(r) == len(out.columns) for r in rows)
