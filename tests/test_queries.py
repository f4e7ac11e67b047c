"""Every query runs at the smallest scale; those with SQL must agree with it."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from pagewright.plans import catalog


def normal(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.fixture(scope="session")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def agree(spark, duck, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(normal(r) for r in df.select(*columns).collect())
    if sql is not None:
        names = ", ".join(f'"{c}"' for c in columns)
        want = Counter(normal(r) for r in duck.execute(f"SELECT {names} FROM ({sql})").fetchall())
        assert got == want


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, folder, name):
    agree(spark, duck, folder, catalog.QUERIES[name], catalog.ORACLE.get(name))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["task_id", "doc_id", "page_index", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
