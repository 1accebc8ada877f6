"""Dashboard metrics over the supplied tables, each at its cheapest grain.

Category metrics run on the part-grain fact, order metrics on the
order-grain fact (see ``orderpulse.plans.fact``); totals over all items read
``lineitem`` alone; only the item listing needs the full item-level join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderpulse.operators import distributions as dist
from orderpulse.operators import kpis, topk
from orderpulse.plans.fact import category_grain_fact, item_totals_fact, order_grain_fact


def top_categories(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    return topk.top_categories(category_grain_fact(spark, sf_dir), n=n)


def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.kpi_summary(order_grain_fact(spark, sf_dir))


def avg_order_value_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.avg_order_value_page(item_totals_fact(spark, sf_dir))


def avg_order_value_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.avg_order_value_sql(item_totals_fact(spark, sf_dir))


def complete_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.complete_rate(order_grain_fact(spark, sf_dir))


def total_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.total_sales(item_totals_fact(spark, sf_dir))


def total_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.total_orders(item_totals_fact(spark, sf_dir))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.daily_orders(order_grain_fact(spark, sf_dir))


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.daily_sales(order_grain_fact(spark, sf_dir))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.monthly_orders(order_grain_fact(spark, sf_dir))


def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.status_distribution(order_grain_fact(spark, sf_dir))


def payment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.payment_distribution(order_grain_fact(spark, sf_dir))


def customer_order_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.customer_order_distribution(order_grain_fact(spark, sf_dir))


def category_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.category_sales(category_grain_fact(spark, sf_dir))


def category_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.category_order_counts(category_grain_fact(spark, sf_dir))
