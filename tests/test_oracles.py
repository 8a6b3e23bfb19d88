"""Every query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from sagebrush import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return "null" if math.isnan(float(v)) else f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, sf, name):
    ours, theirs = plans.QUERIES[name](spark, sf).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
