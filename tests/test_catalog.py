"""Every catalogued query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from quernel.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(value) if isinstance(value, list) else value


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert len(catalog.queries()) > 70


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = [tuple(plain(row[columns.index(c)]) for c in order) for row in found.fetchall()]
    rows = [tuple(plain(r[c]) for c in order) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["l_suppkey", "q"]
    assert set(catalog.queries()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark):
    plan = catalog.queries()["filter_gt"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,25)" in plan and "p_name" not in plan
    shared = catalog.queries()["shared_scan_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert shared.count("FileScan") == 1
