"""Every query with SQL gives DuckDB's rows at sf0.01; every other one runs."""

import math

import duckdb
import pytest

from lorekeep import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]


    def cell(x):
        x = x.item() if hasattr(x, "item") else x
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got.astype(object).where(got.notna(), None)), rows(want.astype(object).where(want.notna(), None))
        assert len(a) == len(b)
        assert a == b
    else:
        assert len(got)
