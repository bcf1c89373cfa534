"""Every driver query of the core against its SQL in DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.queries import core_problems, sequencing

QUERIES = {**core_problems.QUERIES, **sequencing.QUERIES}
SQL = {**core_problems.SQL, **sequencing.SQL}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def tidy(rows):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    assert tidy(tuple(r[c] for c in names) for r in got.collect()) == tidy(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
