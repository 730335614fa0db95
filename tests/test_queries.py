"""Every query of the core with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("None" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        assert table(got) == table(duck.sql(queries.ORACLES[name]).df())
