"""Registered corpus queries against their SQL, and native plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from oracle_check import canon, duck_connect  # noqa: E402

from orderpulse.llm import oracle, queries  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(oracle.all_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries.all_queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(oracle.all_sql()[name])
    assert canon(df.columns, rows) == canon(rel.columns, rel.fetchall())


def test_one_query_for_each_operator():
    names = list(queries.all_queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


@pytest.mark.parametrize("name", ["op4_fingerprints", "op6_license_scan", "op10_line_dedup", "op13_fill_middle"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
