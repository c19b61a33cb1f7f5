"""Each query of the catalog against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from loomdoc import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, float):
        return round(v, 6)
    try:
        return int(v) if float(v) == int(v) else round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, engine, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(cell(r[c]) for c in columns)) for r in df.collect())
    if sql := catalog.ORACLE_SQL.get(name):
        found = engine.sql(sql)
        assert sorted(found.columns) == columns
        theirs = sorted(repr(tuple(cell(dict(zip(found.columns, r))[c]) for c in columns)) for r in found.fetchall())
        assert ours == theirs
    else:
        assert ours
