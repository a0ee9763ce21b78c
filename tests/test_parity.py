"""Every registered query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

import tidemark.plans.catalog as catalog

SLOW = {"stream_ingested", "store_commits_compacted"}


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return int(value) if isinstance(value, float) and value == int(value) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL)))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = catalog.QUERIES[name](spark, sf_dir)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
