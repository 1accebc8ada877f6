"""Every registered query against its DuckDB oracle, plus plan-shape checks."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import canon, duck_connect  # noqa: E402

from conftest import SF_ORACLE, SF_SMALL  # noqa: E402
from orderpulse.plans import catalog, oracle  # noqa: E402

NAMES = sorted(catalog.all_queries())
ORACLE = oracle.all_sql()
DIRECT = [n for n in NAMES if n not in ORACLE]


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_ORACLE)


def test_every_query_has_an_oracle_or_is_listed():
    assert DIRECT == ["dashboard_payload"]
    assert set(ORACLE) <= set(NAMES)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLE])
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_ORACLE)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    assert canon(df.columns, rows) == canon(rel.columns, rel.fetchall())
    # same column types, not just equal values
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
                   for f in df.schema.fields}
    assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "Category", "total"]
    assert 0 < df.count() <= 5


def test_dashboard_payload_sections(spark):
    import json

    rows = {r.section: json.loads(r.payload) for r in E.queries()["dashboard_payload"](spark, SF_SMALL).collect()}
    assert set(rows) == {"kpis", "daily_orders", "top_categories"}
    assert [t["rank"] for t in rows["top_categories"]] == list(range(1, len(rows["top_categories"]) + 1))
    k = E.queries()["kpi_summary"](spark, SF_SMALL).first()
    assert rows["kpis"]["total_orders"] == k.total_orders
    assert sum(d["orders"] for d in rows["daily_orders"]) == k.total_orders


@pytest.mark.parametrize("name", ["kpi_summary", "top_categories", "customer_order_distribution",
                                  "daily_sales", "status_severity"])
def test_partition_count_invariance(spark, name):
    q = E.queries()[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = canon(q(spark, SF_SMALL).columns, [tuple(r) for r in q(spark, SF_SMALL).collect()])
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = canon(q(spark, SF_SMALL).columns, [tuple(r) for r in q(spark, SF_SMALL).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == eight


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(("stream_", "snapshot_", "append",
                                                                        "quarantine", "upsert", "csv_",
                                                                        "publish", "dashboard"))])
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns_and_aggregates_before_join(spark):
    df = E.queries()["kpi_summary"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in \
        df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # partial aggregation on l_orderkey happens below the join with orders
    join_at = plan.find("Join")
    assert join_at > 0 and plan.find("l_orderkey", join_at) > 0


def _formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", ["total_orders", "total_sales", "avg_order_value_page", "avg_order_value_sql"])
def test_totals_scan_once_without_a_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL)).split("== Initial Plan ==")[0]
    assert "Join" not in plan and plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "Exchange SinglePartition" in plan


def test_a_hot_part_key_is_split(spark):
    """Item rows join ``part`` by an exchange on both sides, which adaptive
    execution splits when one part holds a third of the items."""
    from orderpulse.plans.fact import part_columns

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        items = spark.range(0, 300_000, 1, 8).selectExpr(
            "if(id % 3 = 0, 7, id % 5000) as l_partkey", "id as l_orderkey", "uuid() as pad")
        parts = part_columns(spark.range(5000).selectExpr("id as p_partkey", "concat('t', id % 9) as p_type"))
        joined = items.join(parts, items.l_partkey == parts.p_partkey)
        joined = joined.select("l_orderkey", "pad", "Category")
        assert len(joined.toArrow()) == 300_000
        assert "SortMergeJoin(skew=true)" in _plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_keyset_page_pushes_the_key_filter_into_the_scan(spark):
    text = _formatted(spark, E.queries()["order_page_after"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,9999)]" in text


def test_top_k_plans_as_take_ordered(spark):
    assert "TakeOrderedAndProject" in _plan(E.queries()["top_categories"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in _plan(E.queries()["order_page"](spark, SF_SMALL))


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(("stream_", "snapshot_", "append",
                                                                        "quarantine", "upsert", "csv_",
                                                                        "publish", "dashboard"))])
def test_no_python_udf_in_plan(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan
