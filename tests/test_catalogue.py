"""Every registered query with SQL gives the SQL's rows."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tempora.plans import catalogue

SKIPPED = ()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, bool):
        return v
    return round(float(v), 5) if isinstance(v, (int, float)) else v


def rows(table):
    columns = sorted(table.columns)
    return columns, sorted((tuple(map(plain, r)) for r in table[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = rows(catalogue.QUERIES[name](spark, sf).toPandas())
    assert got == rows(duck.execute(catalogue.ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
