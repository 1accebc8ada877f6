"""Additive measures shared by every dashboard aggregate.

Every metric of the reference is a count, a sum, a count of non-null
values, or a ratio of those. So each fact row carries three additive
measures, and a fact may be at any grain:

* ``n_items``  – order-item rows represented by the row ("orders" = rows)
* ``sales_units`` – exact sum of ``grand_total`` in 1/10000 units (nulls
  skipped), an integral decimal
* ``sales_n``  – number of non-null ``grand_total`` values

An item-level table gets ``n_items = 1`` per row (:func:`with_item_measures`);
a fact pre-aggregated to a join key (see ``orderpulse.plans.fact``) carries
partial sums. Re-aggregating partial sums gives the same answer as the
item-level aggregate, which is what lets the plans aggregate *before* a
join and ship far fewer rows through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.schemas import MONEY

N_ITEMS = "n_items"
SALES = "sales_units"
SALES_N = "sales_n"
MEASURES = (N_ITEMS, SALES, SALES_N)

# Money is carried as an exact integer count of 1/10000 currency units.
UNIT_SCALE = 4
UNITS_PER_CURRENCY = 10 ** UNIT_SCALE
# Input type of every units sum: a 20-digit integer decimal. Spark keeps
# values below 10^18 in compact long form, so the sum runs at near-long
# speed, yet it can never overflow the way a ``long`` sum would when one
# key holds a third of 100 TB of items.
UNITS_SUM_INPUT = "decimal(20,0)"


def amount_units(amount: str | Column) -> Column:
    """A money column (decimal or double, at most 4 decimals) as integer units."""
    a = F.col(amount) if isinstance(amount, str) else amount
    return (a.cast(MONEY) * F.lit(UNITS_PER_CURRENCY)).cast("decimal(38,0)")


def units_to_money(units: str | Column) -> Column:
    """Exact units sum back to a 4-decimal currency amount."""
    u = F.col(units) if isinstance(units, str) else units
    return (u.cast("decimal(38,0)") / F.lit(UNITS_PER_CURRENCY)).cast("decimal(38,4)")


def item_measures(amount: str | Column = "grand_total") -> list[Column]:
    """Measure columns for one item row with a money column."""
    u = amount_units(amount)
    return [
        F.lit(1).cast("long").alias(N_ITEMS),
        u.alias(SALES),
        F.when(u.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias(SALES_N),
    ]


def with_item_measures(df: DataFrame, amount: str = "grand_total") -> DataFrame:
    """Add the three measures to an item-level table (one row = one item)."""
    return df.select("*", *item_measures(amount))


def partial_measures(units: str | Column) -> list[Column]:
    """Aggregates that pre-aggregate item rows, given per-item integer units
    (``long`` or integral decimal), to any grain."""
    u = F.col(units) if isinstance(units, str) else units
    u = u.cast(UNITS_SUM_INPUT)
    return [
        F.count(F.lit(1)).alias(N_ITEMS),
        F.sum(u).alias(SALES),
        F.count(u).alias(SALES_N),
    ]


def merge_measures() -> list[Column]:
    """Aggregate expressions that combine partial measures."""
    return [
        F.sum(N_ITEMS).alias(N_ITEMS),
        F.sum(SALES).alias(SALES),
        F.sum(SALES_N).alias(SALES_N),
    ]


def sales_money(units_sum: Column) -> Column:
    """Exact currency total of a units sum (null stays null)."""
    return units_to_money(units_sum)


def sales_double(units_sum: Column) -> Column:
    """Currency total as double, converted from the exact decimal once."""
    return units_to_money(units_sum).cast("double")
