"""Top categories by sales.

``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: every task keeps
its own n best groups and only those reach the final merge, so the sort never
sees the full grouped result. Ties on the total are broken by category name
so the answer is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.operators.distributions import sum_by


def top_by_sum(fact: DataFrame, key: str, n: int = 5, value: str = "total",
               drop_null_keys: bool = True) -> DataFrame:
    """(rank, key, value) for the n keys with the largest sum, rank 1 first."""
    if n < 1:
        raise ValueError("n must be at least 1")
    grouped = sum_by(fact, key, value=value, drop_null_keys=drop_null_keys)
    top = grouped.orderBy(F.col(value).desc(), F.col(key).asc_nulls_first()).limit(n)
    # the window below sees at most n rows
    w = Window.orderBy(F.col(value).desc(), F.col(key).asc_nulls_first())
    return top.select(F.row_number().over(w).cast("long").alias("rank"), key, value)


def top_categories(fact: DataFrame, n: int = 5, drop_null_keys: bool = True) -> DataFrame:
    """The n categories with the highest sales: (rank, Category, total)."""
    return top_by_sum(fact, "Category", n=n, value="total", drop_null_keys=drop_null_keys)
