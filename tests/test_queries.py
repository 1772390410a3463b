"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lumenfold.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return c


def plain(row):
    return tuple("N" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*cols).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == cols
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    assert got == sorted(plain(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())
