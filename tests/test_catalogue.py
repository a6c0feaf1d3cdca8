"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from finlode.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(values):
    def plain(v):
        if isinstance(v, float):
            return round(v, 5)
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted(repr([plain(v) for v in r]) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    expected = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    assert rows(got) == rows(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_imports_without_the_training_operators(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
