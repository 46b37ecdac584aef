"""Every query with SQL gives the same rows as DuckDB on the small driver tables."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gaugewright.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(Path(SF).iterdir()):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, SF).count()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
