"""Every core query with a statement against DuckDB on the smallest data; plan shapes."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from clauselake.plans import core_queries, library_queries, problem_queries, problem_sql
from verify import norm

SF = "/root/testdata/sf0.001"
CASES = {**problem_queries.QUERIES, **core_queries.QUERIES, **library_queries.QUERIES}
STATEMENTS = {**problem_sql.SQL, **core_queries.SQL, **library_queries.SQL}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(CASES))
def test_matches_statement(spark, con, name):
    got = CASES[name](spark, SF).toPandas()
    if name in STATEMENTS:
        want = con.execute(STATEMENTS[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got).equals(norm(want))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["join_library", "join_children", "join_interval", "star_revenue", "p1_found"])
def test_no_cartesian_product(spark, name):
    plan = CASES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_large_columns(spark):
    plan = core_queries.scan_list(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "file_text" not in re.search(r"ReadSchema: (\S+)", plan)[1]
    keyed = core_queries.scan_keyed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(document_type), EqualTo(document_type,Regulation)" in keyed
