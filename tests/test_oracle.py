"""Every query that has an oracle gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.operators import QUERIES


def rows(table):
    return sorted(tuple((k, repr(round(r[k], 9) + 0.0) if isinstance(r[k], float) else repr(r[k])) for k in sorted(r)) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows(key, spark, folder, duck):
    got = QUERIES[key].build(spark, folder).toArrow()
    want = duck.sql(QUERIES[key].oracle).fetch_arrow_table() if hasattr(duck, "fetch_arrow_table") else duck.sql(QUERIES[key].oracle).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    kind = lambda t: {f.name: str(f.type).replace("large_", "") for f in t.schema}
    assert kind(got) == kind(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
