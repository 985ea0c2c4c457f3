"""Every query of the sales engine against its DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from saleglass import registry

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return float(v) if isinstance(v, (int, float)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
