"""Queries of the folder that have SQL, against it."""

import duckdb
import pandas as pd
import pytest

from sluice.llm import registry

DATA = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in frame[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours = rows(registry.queries()[name](spark, DATA).toPandas())
    assert ours[1] and ours == rows(duck.execute(registry.oracle_sql()[name]).fetchdf())
