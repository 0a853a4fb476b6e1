"""Every registered query: the shape of its plan, and its rows against its SQL on DuckDB."""

import os

import pytest

from repolith.plans import catalog
from repolith.plans.testviews import TABLES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
#: the busy keys of the throttle take a Python step
PYTHON = {"throttle_user", "throttle_type"}
#: all commits are numbered, by the hour; the text reader looks from one record to the next
FULL_RANKS = {"commit_batches", "log_changes_text"}
#: further views of the same score, left to the driver's check at the next scale
SAME_SCORE = {
    "confidence_facts", "confidence_total", "confidence_gaps", "score_uplift", "open_gaps", "report_json", "report_gaps",
    "report_questions", "run_metadata",
}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def check_plan(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition"):
        assert node not in plan, node
    if name not in PYTHON:
        assert "InPandas" not in plan
    if name not in FULL_RANKS:
        # every window ranks for a top-k, cut before and after the exchange
        lines = plan.splitlines()
        windows = sum(1 for x in lines if "- Window [" in x)
        assert windows == sum(1 for x in lines if "WindowGroupLimit" in x and x.rstrip().endswith("Final"))


def plain(value):
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SAME_SCORE))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    check_plan(df, name)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
