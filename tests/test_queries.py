"""Every query with SQL returns what DuckDB returns; the others return rows."""

import os

import duckdb
import pandas as pd
import pytest

from envspark.plans import derived, documents, lines, listings, places, registry, scans, storms  # noqa: F401  (all but registry register their queries)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if pd.isna(v) else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    mine = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        other = duck.sql(registry.ORACLE_SQL[name]).fetchdf()
        assert sorted(mine.columns) == sorted(other.columns)
        a, b = _rows(mine), _rows(other)
        assert len(a) == len(b)
        assert a == b
    assert len(mine)
