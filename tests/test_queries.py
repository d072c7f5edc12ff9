"""Every registered query with SQL against DuckDB on the smallest tables, and the contract of the entry."""

import glob
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    mine = Counter(tuple(map(cell, r)) for r in df.select(*columns).collect())
    theirs = Counter(tuple(map(cell, r)) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_run(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_blind_joins(spark):
    """No query of the core multiplies two tables; joins with one-row aggregates are broadcast."""
    from foliant.plans.queries import QUERIES

    for name, query in QUERIES.items():
        if name == "streamed_counts":
            continue
        plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
