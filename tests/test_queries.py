"""Every query against its SQL in DuckDB, and the rest for rows, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from sluice import catalog
from sluice.core.session import TABLES

DATA = os.environ.get("SLUICE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (bool, str, bytes)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(float(value), 5)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    ours = rows(catalog.queries()[name](spark, DATA).toPandas())
    assert ours == rows(duck.execute(catalog.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
