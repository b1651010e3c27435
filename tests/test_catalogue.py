import math
import os

import duckdb
import pytest

from quillmesh.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_plans_broadcast_dimensions_and_have_no_cartesian(spark):
    plan = QUERIES["j01_dimension_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_coverage_of_sources_counts_before_it_joins(spark):
    join = [x for x in QUERIES["j14_source_coverage"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1:]]
    assert len(join) == 1 and join[0].count("Aggregate ") >= 2  # both sides are counted below the only join


def test_cohort_counts_runs_before_it_joins(spark):
    plan = QUERIES["k05_cohort"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Aggregate ") >= 3  # each join meets runs counted by source
