"""The dashboard's KPI payload as one consistent snapshot (SNK-10).

The reference pushed six values from six separate statements every few
seconds, so one payload could mix two states. Here the payload's sections
(the KPIs, the daily order trend as an ordered array, the top categories as
ranked entries) are written together as one version of a payload table, and
readers follow the pointer, so they always see one consistent set.

Array sizes are bounded by the data's date range (days) and by ``top_n``,
not by the row count, so each section stays small at any scale. The
``collect_list`` over days runs in the final single-row aggregate, whose
input is at most one row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.operators import topk
from orderpulse.operators.kpis import COMPLETE_ITEMS, complete_items, kpi_aggregates, kpi_columns
from orderpulse.operators.measures import N_ITEMS, SALES, SALES_N
from orderpulse.plans.fact import category_grain_fact, order_grain_fact
from orderpulse.session import scratch_path
from orderpulse.sinks.tables import VersionedTable


def build_payload(order_fact: DataFrame, category_fact: DataFrame, top_n: int = 5) -> DataFrame:
    """Three rows, one per payload section (``kpis``, ``daily_orders``,
    ``top_categories``), each with its JSON text.

    The KPIs and the daily trend come from one aggregate by working day
    (one pass over the order-grain fact, at most one row per day), turned
    into two section rows with ``inline``; the top categories come from the
    part-grain fact. Sections are stacked with a union, not joined.
    """
    by_day = order_fact.groupBy("Working_Date").agg(
        F.sum(N_ITEMS).alias(N_ITEMS), F.sum(SALES).alias(SALES), F.sum(SALES_N).alias(SALES_N),
        F.sum(complete_items("status")).alias(COMPLETE_ITEMS))
    day_entry = F.when(F.col("Working_Date").isNotNull(),
                       F.struct("Working_Date", F.col(N_ITEMS).cast("long").alias("orders")))
    raw = by_day.agg(*kpi_aggregates(), F.sort_array(F.collect_list(day_entry)).alias("_daily"))
    two = raw.select(F.inline(F.array(
        F.struct(F.lit("kpis").alias("section"),
                 F.to_json(F.struct(*kpi_columns())).alias("payload")),
        F.struct(F.lit("daily_orders").alias("section"),
                 F.to_json("_daily").alias("payload")))))
    top = topk.top_categories(category_fact, n=top_n).agg(
        F.sort_array(F.collect_list(F.struct("rank", "Category", "total"))).alias("v"))
    top_row = top.select(F.lit("top_categories").alias("section"), F.to_json("v").alias("payload"))
    return two.unionByName(top_row)


def dashboard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the payload as a new version of a payload table; return it."""
    table = VersionedTable(spark, scratch_path(spark, "payload"))
    payload = build_payload(order_grain_fact(spark, sf_dir), category_grain_fact(spark, sf_dir))
    table.write_version(payload)
    return table.read()


def payload_rows(payload: DataFrame) -> DataFrame:
    """The payload's JSON read back: (section, label, value) for every KPI,
    day and ranked category."""
    kpis = ["total_orders", "total_sales", "avg_order_value", "avg_order_value_page", "complete_rate"]
    entry = lambda label, value: F.struct(label.alias("label"), value.cast("double").alias("value"))
    k = F.from_json("payload", ", ".join(f"{c} double" for c in kpis))
    d = F.from_json("payload", "array<struct<Working_Date:date,orders:long>>")
    t = F.from_json("payload", "array<struct<rank:long,Category:string,total:double>>")
    rows = (F.when(F.col("section") == "kpis", F.array(*[entry(F.lit(c), k[c]) for c in kpis]))
            .when(F.col("section") == "daily_orders",
                  F.transform(d, lambda x: entry(F.date_format(x["Working_Date"], "yyyy-MM-dd"), x["orders"])))
            .otherwise(F.transform(t, lambda x: entry(F.concat_ws(" ", x["rank"].cast("string"), x["Category"]), x["total"]))))
    return payload.select("section", F.inline(rows))


def dashboard_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10, all three sections, as rows."""
    return payload_rows(dashboard_payload(spark, sf_dir))
