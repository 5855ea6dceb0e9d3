"""Every registered query with SQL gives the SQL's rows at the smallest size; plans keep their shape."""

import inspect
import os

import duckdb
import pandas as pd
import pytest

from hazardlens.plans import queries
from hazardlens.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FEW = ("line_coverage", "total_risk", "function_churn", "longest_prefix_groups", "ladder_fingerprint", "mann_whitney", "top_quartile", "lcov_parse", "export_reachability")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def cells(df: pd.DataFrame) -> list:
    names = sorted(df.columns)
    plain = lambda x: None if x is None or x != x else float(x) if isinstance(x, float) else str(x)
    return sorted(repr([plain(x) for x in r]) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", FEW)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert cells(QUERIES[name](spark, SF).toPandas()) == cells(con.execute(ORACLE_SQL[name]).fetchdf())


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["line_coverage"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_comment" not in plan and "p_retailprice" not in plan


@pytest.mark.parametrize("name", ["line_coverage_binned", "union_of_backends"])
def test_functions_are_not_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "BroadcastHashJoin [path#" not in x] == []


def test_entry_module():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())


def test_bootstrap_runs_all_draws(monkeypatch):
    seen = {}
    bound = inspect.signature(queries.model.bootstrap_interval)

    def record(*args, **named):
        call = bound.bind(*args, **named)
        call.apply_defaults()
        seen.update(call.arguments)

    monkeypatch.setattr(queries.model, "bootstrap_interval", record)
    monkeypatch.setattr(queries, "_features", lambda t: None)
    queries.bootstrap_ci(None)
    assert seen["draws"] == 1000


def test_export_closure_is_whole(spark):
    orders, customer = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer"))
    to: dict = {}
    for a, b in zip(orders.o_custkey, orders.o_orderkey % len(customer) + 1, strict=True):
        to.setdefault(a, set()).add(b)
    seen, left = set(), list(customer.c_custkey[customer.c_nationkey == 0])
    while left:
        node = left.pop()
        if node not in seen:
            seen.add(node)
            left += to.get(node, ())
    assert sorted(r.node for r in QUERIES["export_closure"](spark, SF).collect()) == sorted(seen)
