"""Every registered query against its SQL, over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from docweave.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    got, oracle = df.collect(), catalog.oracle_sql().get(name)
    if oracle is None:
        assert df.columns
        return
    r = sql.execute(oracle)
    names = sorted(d[0] for d in r.description)
    assert sorted(df.columns) == names
    at = [[d[0] for d in r.description].index(c) for c in names]
    assert sorted(tuple(norm(row[c]) for c in names) for row in got) == sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
