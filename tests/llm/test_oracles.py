"""The corpus operators that SQL can express give DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from tidemark.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
