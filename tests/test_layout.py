"""Bucketed layout: same answers, and no shuffle below the order-grain join."""

from orderpulse.operators import kpis, topk
from orderpulse.plans import layout
from orderpulse.plans.fact import category_grain_fact, order_grain_fact

from conftest import SF_SMALL


def test_bucketed_layout_matches_and_skips_the_shuffle(spark, scratch):
    root = scratch("layout")
    layout.write_layout(spark, SF_SMALL, root, buckets=4, prefix="t1")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the sort-merge join
    try:
        fact = layout.order_grain_bucketed(spark, prefix="t1")
        got = kpis.kpi_summary(fact).first()
        plan = fact._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == kpis.kpi_summary(order_grain_fact(spark, SF_SMALL)).first()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    top = topk.top_categories(layout.category_grain_bucketed(spark, prefix="t1")).collect()
    assert top == topk.top_categories(category_grain_fact(spark, SF_SMALL)).collect()


def test_register_layout_in_a_new_catalog(spark, scratch):
    root = scratch("layout2")
    layout.write_layout(spark, SF_SMALL, root, buckets=2, prefix="t2")
    other = spark.newSession()
    layout.register_layout(other, root, buckets=2, prefix="t3")
    assert other.table("t3_orders_by_order").count() == spark.table("t2_orders_by_order").count()
