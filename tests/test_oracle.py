"""Every registered plan against its SQL, run by DuckDB over the same tables."""

import duckdb
import pandas as pd
import pytest
from siftline.plans import derived, tables, trees, whole  # noqa: F401  the others register their plans beside those of tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(None if not isinstance(x, (list, tuple)) and pd.isna(x) else x for x in r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(tables.oracle_sql()))
def test_plan_equals_sql(spark, sf, duck, name):
    got, want = tables.queries()[name](spark, sf).toPandas(), duck.sql(tables.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
