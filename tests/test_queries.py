"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import check_queries as check
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def test_entry(spark):
    assert {r["metric"] for r in entry(spark).collect()} == {"records", "invoice_vat", "invoice_total"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    cols, kinds = [d[0] for d in cur.description], {d[0]: str(d[1]).lower() for d in cur.description}
    assert sorted(cols) == sorted(df.columns)
    for f in df.schema.fields:
        assert check.same_kind(f.dataType.simpleString(), kinds[f.name]), f.name
    assert check.rows_of(df.columns, got) == check.rows_of(cols, cur.fetchall())
