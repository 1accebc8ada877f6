"""Headline KPIs (total orders, total sales, average order value, completion
rate), all computed in one aggregate pass.

The reference issues six separate statements per refresh, so one payload may
mix states; here every KPI comes out of a single ``agg`` over one scan
(partial aggregation on the map side, a one-row final merge).

Empty input gives 0 for every KPI, never a division error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.labels import is_complete
from orderpulse.operators.measures import N_ITEMS, SALES, SALES_N, sales_money


def _safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double; 0 when ``den`` is 0 or null."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


COMPLETE_ITEMS = "complete_items"


def complete_items(status: str = "status") -> Column:
    """Items whose status is ``complete`` (additive, like the other measures)."""
    return F.when(is_complete(status), F.col(N_ITEMS)).otherwise(F.lit(0)).cast("long")


def kpi_aggregates(complete: Column | None = None) -> list[Column]:
    """Raw additive aggregates behind every KPI. ``complete`` is the
    per-row complete-item count (default: the ``complete_items`` column)."""
    c = F.col(COMPLETE_ITEMS) if complete is None else complete
    return [
        F.coalesce(F.sum(N_ITEMS), F.lit(0)).cast("long").alias("total_orders"),
        sales_money(F.sum(SALES)).alias("_sales"),
        F.coalesce(F.sum(SALES_N), F.lit(0)).cast("long").alias("_sales_n"),
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("_complete"),
    ]


def kpi_columns() -> list[Column]:
    """The five KPI columns over :func:`kpi_aggregates` output."""
    sales = F.coalesce(F.col("_sales").cast("double"), F.lit(0.0))
    return [
        F.col("total_orders"),
        sales.alias("total_sales"),
        _safe_ratio(F.col("_sales"), F.col("_sales_n")).alias("avg_order_value"),
        _safe_ratio(F.col("_sales"), F.col("total_orders")).alias("avg_order_value_page"),
        _safe_ratio(F.col("_complete") * F.lit(100), F.col("total_orders")).alias("complete_rate"),
    ]


def kpis_from_aggregates(raw: DataFrame) -> DataFrame:
    return raw.select(*kpi_columns())


def kpi_summary(fact: DataFrame, status: str = "status") -> DataFrame:
    """One row: total_orders, total_sales, avg_order_value (SQL form: over
    non-null amounts), avg_order_value_page (page form: over all rows),
    complete_rate (percent of rows whose status is ``complete``)."""
    return kpis_from_aggregates(fact.agg(*kpi_aggregates(complete_items(status))))


def kpi_summary_from_partials(partials: DataFrame) -> DataFrame:
    """KPIs from rows that already carry the measures and ``complete_items``
    (for example the state of a streaming aggregate)."""
    return kpis_from_aggregates(partials.agg(*kpi_aggregates()))


def total_orders(fact: DataFrame) -> DataFrame:
    return kpi_summary(fact).select("total_orders")


def total_sales(fact: DataFrame) -> DataFrame:
    return kpi_summary(fact).select("total_sales")


def avg_order_value_sql(fact: DataFrame) -> DataFrame:
    """AVG over non-null amounts; 0 on empty input."""
    return kpi_summary(fact).select("avg_order_value")


def avg_order_value_page(fact: DataFrame) -> DataFrame:
    """Sum of amounts divided by all rows (nulls count in the denominator)."""
    return kpi_summary(fact).select(F.col("avg_order_value_page").alias("avg_order_value"))


def complete_rate(fact: DataFrame, status: str = "status") -> DataFrame:
    """Percentage of rows with status ``complete``; 0 on empty input."""
    return kpi_summary(fact, status).select("complete_rate")
