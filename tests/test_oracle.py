"""Every query with SQL equals that SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from breakline.plans import load
from breakline.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(spark, duck, name: str, query, sql: str) -> None:
    df = query(spark, SF)
    cur = duck.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == want, name


@pytest.mark.parametrize("name", sorted(load()[1]))
def test_equals_sql(spark, duck, name):
    same(spark, duck, name, load()[0][name], load()[1][name])


@pytest.mark.parametrize("name", sorted(set(load()[0]) - set(load()[1])))
def test_runs(spark, name):
    assert load()[0][name](spark, SF).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
