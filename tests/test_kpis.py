"""KPI, distribution and top-k operators on hand-made order-item tables
(the edge cases of FIXTURES.md §2)."""

import datetime as dt
from decimal import Decimal

import pytest

from orderpulse.operators import distributions as dist
from orderpulse.operators import kpis, topk
from orderpulse.operators.measures import with_item_measures

SCHEMA = ("status string, grand_total decimal(18,4), Category string, "
          "Working_Date date, payment_method string, Customer_ID long")
D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def fact(spark, rows):
    return with_item_measures(spark.createDataFrame(rows, SCHEMA))


def test_null_grand_total_page_vs_sql_average(spark):
    f = fact(spark, [("complete", Decimal("10"), "A", D1, "card", 1),
                     ("canceled", None, "A", D1, "card", 1)])
    k = kpis.kpi_summary(f).first()
    assert k.total_orders == 2
    assert k.total_sales == 10.0
    assert k.avg_order_value == 10.0          # SQL AVG skips the null
    assert k.avg_order_value_page == 5.0      # page form divides by all rows
    assert k.complete_rate == 50.0


def test_empty_table_gives_zeros(spark):
    k = kpis.kpi_summary(fact(spark, [])).first()
    assert (k.total_orders, k.total_sales, k.avg_order_value, k.avg_order_value_page,
            k.complete_rate) == (0, 0.0, 0.0, 0.0, 0.0)


def test_complete_rate_is_case_sensitive(spark):
    f = fact(spark, [("complete", Decimal(1), "A", D1, "x", 1),
                     ("Complete", Decimal(1), "A", D1, "x", 1),
                     (None, Decimal(1), "A", D1, "x", 1),
                     ("complete", Decimal(1), "A", D1, "x", 1)])
    assert kpis.complete_rate(f).first().complete_rate == 50.0


def test_top_categories_ties_by_name_and_null_policy(spark):
    f = fact(spark, [("complete", Decimal(5), "B", D1, "x", 1),
                     ("complete", Decimal(5), "A", D1, "x", 1),
                     ("complete", Decimal(9), None, D1, "x", 1),
                     ("complete", Decimal(1), "C", D1, "x", 1)])
    got = [(r.rank, r.Category, r.total) for r in topk.top_categories(f, n=2).collect()]
    assert got == [(1, "A", 5.0), (2, "B", 5.0)]
    keep = [(r.rank, r.Category) for r in topk.top_categories(f, n=2, drop_null_keys=False).collect()]
    assert keep == [(1, None), (2, "A")]
    with pytest.raises(ValueError):
        topk.top_categories(f, n=0)


def test_daily_orders_null_date_policy(spark):
    f = fact(spark, [("complete", Decimal(1), "A", D2, "x", 1),
                     ("complete", Decimal(1), "A", D1, "x", 1),
                     ("complete", Decimal(1), "A", None, "x", 1)])
    sql_form = [(r.Working_Date, r.orders) for r in dist.daily_orders(f).collect()]
    page_form = [(r.Working_Date, r.orders) for r in dist.daily_orders(f, drop_null_keys=True).collect()]
    assert sql_form == [(None, 1), (D1, 1), (D2, 1)]
    assert page_form == [(D1, 1), (D2, 1)]


def test_distributions(spark):
    f = fact(spark, [("complete", Decimal("1.5"), "A", D1, "card", 1),
                     ("canceled", Decimal("2.5"), "B", D1, "cash", 1),
                     ("complete", Decimal("3"), "A", dt.date(2024, 2, 3), "card", 2)])
    assert {(r.status, r.orders) for r in dist.status_distribution(f).collect()} == \
        {("complete", 2), ("canceled", 1)}
    assert {(r.Category, r.sales) for r in dist.category_sales(f).collect()} == {("A", 4.5), ("B", 2.5)}
    assert [(r.month, r.orders) for r in dist.monthly_orders(f).collect()] == \
        [("2024-01", 2), ("2024-02", 1)]
    assert [(r.orders, r.customers) for r in dist.customer_order_distribution(f).collect()] == \
        [(1, 1), (2, 1)]
    assert {(r.payment_method, r.orders) for r in dist.payment_distribution(f).collect()} == \
        {("card", 2), ("cash", 1)}
    m = dist.as_map(dist.category_order_counts(f), "Category", "orders").first().map
    assert m == {"A": 2, "B": 1}


def test_all_null_group_sums_to_zero(spark):
    f = fact(spark, [("complete", None, "A", D1, "x", 1)])
    assert dist.category_sales(f).first().sales == 0.0


def test_exact_money_sum(spark):
    # 0.1 + 0.2 in double is 0.30000000000000004; the exact sum is 0.3
    f = fact(spark, [("complete", Decimal("0.1"), "A", D1, "x", 1),
                     ("complete", Decimal("0.2"), "A", D1, "x", 1)])
    assert kpis.total_sales(f).first().total_sales == 0.3


def test_table_page_rows(spark):
    from orderpulse.operators.listing import table_page_rows
    from orderpulse.schemas import LISTING_COLUMNS

    raw = spark.createDataFrame(
        [("1", "complete", "t", "1.0", "1", "2.0", "", "card", "7"),
         ("", "canceled", "t", "1.0", "1", "2.0", "A", "card", "7"),
         (None, "canceled", "t", "1.0", "1", "2.0", "A", "card", "7"),
         ("3", "processing", "t", "1.0", "1", "2.0", None, "cash", "8")],
        ", ".join(f"{c} string" for c in LISTING_COLUMNS))
    got = [(r.item_id, r.Category, r.severity) for r in table_page_rows(raw).collect()]
    assert got == [("1", "N/A", "success"), ("3", "N/A", None)]
