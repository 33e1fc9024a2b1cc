"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from vellum.plans import catalogue
from vellum.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 8) if math.isfinite(v) else str(v)
    return v


def rows(cols, raw):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in raw), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, want.fetchall())


def test_every_query_runs(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)):
        assert catalogue.QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)
