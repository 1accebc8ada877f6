"""The pre-aggregating fact plans against a brute-force join, on a small star
schema where one part holds a third of all items and some items are orphans."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal

import pytest

from orderpulse.operators import distributions as dist
from orderpulse.operators import kpis, topk
from orderpulse.plans.fact import STATUS_CODES, category_grain_fact, item_fact, order_grain_fact


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("star"))
    orders = [(o, o % 7, "FOP"[o % 3], 1000.0, dt.datetime(2024, 1, 1 + o % 5), f"{o % 4}-P")
              for o in range(60)]
    parts = [(p, f"part{p}", "B", ["ECONOMY", "LARGE", "SMALL"][p % 3], 1, 1.0) for p in range(10)]
    items = []
    for i in range(300):
        okey = i % 60
        pkey = 0 if i % 3 == 0 else 1 + i % 9          # part 0 holds a third of the items
        price = round(10 + (i * 37 % 1000) / 100, 2)
        disc = (i % 11) / 100
        items.append((okey, pkey, 1, i % 7, 1.0 * (1 + i % 5), price, disc, 0.0, "A", "F", dt.datetime(2024, 2, 1)))
    items.append((999, 1, 1, 1, 1.0, 5.55, 0.0, 0.0, "A", "F", dt.datetime(2024, 2, 1)))   # no such order
    items.append((3, 999, 1, 1, 1.0, 7.77, 0.1, 0.0, "A", "F", dt.datetime(2024, 2, 1)))   # no such part
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                  "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
                                 "p_retailprice double").write.parquet(f"{root}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
                          ).write.parquet(f"{root}/lineitem.parquet")
    omap = {o[0]: o for o in orders}
    pmap = {p[0]: p for p in parts}
    joined = [(it, omap[it[0]], pmap[it[1]]) for it in items if it[0] in omap and it[1] in pmap]
    return root, joined


def amount(it):
    return Decimal(str(it[5])) * (1 - Decimal(str(it[6])))


def test_category_totals_match_brute_force(spark, star):
    root, joined = star
    want = defaultdict(Decimal)
    for it, _, p in joined:
        want[p[3]] += amount(it)
    got = {r.Category: r.sales for r in dist.category_sales(category_grain_fact(spark, root, fk_integrity=False)).collect()}
    assert got == {k: float(v) for k, v in want.items()}
    top = [(r.Category, r.total) for r in topk.top_categories(category_grain_fact(spark, root, False), n=2).collect()]
    assert top == sorted(((k, float(v)) for k, v in want.items()), key=lambda kv: (-kv[1], kv[0]))[:2]


def test_order_kpis_match_brute_force(spark, star):
    root, joined = star
    k = kpis.kpi_summary(order_grain_fact(spark, root, fk_integrity=False)).first()
    total = sum(amount(it) for it, _, _ in joined)
    complete = sum(1 for _, o, _ in joined if STATUS_CODES[o[2]] == "complete")
    assert k.total_orders == len(joined)
    assert k.total_sales == float(total)
    assert k.complete_rate == complete * 100 / len(joined)
    daily = {r.Working_Date: r.orders for r in dist.daily_orders(order_grain_fact(spark, root, False)).collect()}
    want = defaultdict(int)
    for _, o, _ in joined:
        want[o[4].date()] += 1
    assert daily == dict(want)


def test_fk_integrity_flag(spark, star):
    root, joined = star
    assumed = kpis.kpi_summary(order_grain_fact(spark, root, fk_integrity=True)).first().total_orders
    checked = kpis.kpi_summary(order_grain_fact(spark, root, fk_integrity=False)).first().total_orders
    full = item_fact(spark, root).count()
    assert checked == full == len(joined)
    assert assumed == len(joined) + 1      # the item whose part is missing is kept when FK integrity is assumed


def test_hot_key_is_pre_aggregated_before_the_join(spark, star):
    root, _ = star
    plan = category_grain_fact(spark, root)._jdf.queryExecution().executedPlan().toString()
    # partial aggregate on l_partkey sits below the exchange that feeds the join
    assert "partial_sum" in plan and "Exchange hashpartitioning(l_partkey" in plan
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning(l_partkey")
