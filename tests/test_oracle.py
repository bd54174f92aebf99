"""Every registered query of the library against its SQL, in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from skein import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    out = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[k]) for k in at]) for r in out.fetchall())
