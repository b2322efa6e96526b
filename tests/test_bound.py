"""Every bound query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans import bound, bound_code, bound_runs  # noqa: F401  registers

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NA or x != x:
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x


def norm(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr([plain(v) for v in row]) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(bound.SQL))
def test_query_equals_sql(spark, con, name):
    assert norm(bound.QUERIES[name](spark, DATA).toPandas()) == norm(con.execute(bound.SQL[name]).df())


def test_call_tree(spark):
    rows = bound.QUERIES["call_tree"](spark, DATA).collect()
    assert [r["depth"] for r in rows][:1] == [0] and sum(r["expanded"] for r in rows) == len({r["name"] for r in rows if r["expanded"]})


def test_every_pattern_has_rows(spark):
    rows = bound.QUERIES["code_patterns"](spark, DATA).groupBy("pattern").count().collect()
    assert {r["pattern"] for r in rows} == {"async_functions", "error_handlers", "http_calls", "env_access"} and all(r["count"] > 9 for r in rows)


def test_the_derived_tree_is_planned_once(spark):
    """The plans of the tree's tables and of its pattern search begin with the stored tree, and don't derive it again for each use."""
    i = bound_code.derived_index(spark, DATA, marked=True)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (i.files, i.calls, i.symbols, bound.QUERIES["code_patterns"](spark, DATA))]
    assert not any("o_custkey" in plan or "c_custkey" in plan for plan in plans)
    assert len(plans[-1]) < 200_000, len(plans[-1])
