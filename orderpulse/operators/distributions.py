"""Grouped counts and sums behind the trend and distribution charts.

Each is a plain ``groupBy().agg()``: Spark aggregates partially on the map
side, so even a key holding a third of all rows reaches the shuffle as one
row per map task. Results are ordered rows (key, value); a key→value map is
available through :func:`as_map` for callers that want the reference's dict.

``drop_null_keys``: pandas ``groupby`` drops a null key, SQL ``GROUP BY``
keeps it as its own group. The default follows SQL (keep); pass True for the
page form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.measures import N_ITEMS, SALES, sales_double


def _keyed(fact: DataFrame, key: str | Column, name: str, drop_null_keys: bool) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    df = fact.select(k.alias(name), N_ITEMS, SALES)
    if drop_null_keys:
        df = df.where(F.col(name).isNotNull())
    return df


def count_by(fact: DataFrame, key: str | Column, name: str | None = None,
             value: str = "orders", drop_null_keys: bool = False) -> DataFrame:
    """Rows per key (sum of ``n_items``)."""
    name = name or (key if isinstance(key, str) else "key")
    return (_keyed(fact, key, name, drop_null_keys)
            .groupBy(name).agg(F.sum(N_ITEMS).cast("long").alias(value)))


def sum_by(fact: DataFrame, key: str | Column, name: str | None = None,
           value: str = "sales", drop_null_keys: bool = False) -> DataFrame:
    """Exact sum of amounts per key, reported as double; a group
    whose amounts are all null reports 0, as ``sum()`` does in pandas."""
    name = name or (key if isinstance(key, str) else "key")
    return (_keyed(fact, key, name, drop_null_keys)
            .groupBy(name)
            .agg(F.coalesce(sales_double(F.sum(SALES)), F.lit(0.0)).alias(value)))


def daily_orders(fact: DataFrame, date: str = "Working_Date", drop_null_keys: bool = False) -> DataFrame:
    """Orders per working day, ascending by date."""
    return count_by(fact, date, drop_null_keys=drop_null_keys).orderBy(date)


def daily_sales(fact: DataFrame, date: str = "Working_Date", drop_null_keys: bool = False) -> DataFrame:
    """Sales per working day, ascending by date."""
    return sum_by(fact, date, drop_null_keys=drop_null_keys).orderBy(date)


def monthly_orders(fact: DataFrame, date: str = "Working_Date", drop_null_keys: bool = False) -> DataFrame:
    """Orders per calendar month (``yyyy-MM``), ascending."""
    month = F.date_format(F.col(date), "yyyy-MM")
    return count_by(fact, month, "month", drop_null_keys=drop_null_keys).orderBy("month")


def status_distribution(fact: DataFrame, drop_null_keys: bool = False) -> DataFrame:
    return count_by(fact, "status", drop_null_keys=drop_null_keys)


def payment_distribution(fact: DataFrame, drop_null_keys: bool = False) -> DataFrame:
    return count_by(fact, "payment_method", drop_null_keys=drop_null_keys)


def category_sales(fact: DataFrame, drop_null_keys: bool = False) -> DataFrame:
    return sum_by(fact, "Category", drop_null_keys=drop_null_keys)


def category_order_counts(fact: DataFrame, drop_null_keys: bool = False) -> DataFrame:
    return count_by(fact, "Category", drop_null_keys=drop_null_keys)


def customer_order_distribution(fact: DataFrame, customer: str = "Customer_ID") -> DataFrame:
    """How many customers placed n orders, for each n.

    Two aggregations: orders per customer, then customers per order count.
    Both aggregate partially before their shuffle, so neither a very active
    customer nor a very common count concentrates rows in one task.
    """
    per_customer = (fact.where(F.col(customer).isNotNull())
                    .groupBy(customer).agg(F.sum(N_ITEMS).cast("long").alias("orders")))
    return (per_customer.groupBy("orders")
            .agg(F.count(F.lit(1)).cast("long").alias("customers"))
            .orderBy("orders"))


def as_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One-row ``map<key, value>`` of a small grouped result.

    Only for results whose key set is bounded (categories, statuses, days in
    a range); the map is built on an executor, not on the driver.
    """
    return df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value)))).alias("map"))
