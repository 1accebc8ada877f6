"""Incremental dashboard payload (SNK-10 as a stream).

The reference re-ran six statements over the whole table every 5 seconds.
Here order items arrive as a stream, and each micro-batch is one small change:
its additive measures are summed over everything, by working day, by category
and by both (grouping sets, one pass over the batch), and these sums are added
to a keyed table of measures under the batch's tag. So a trigger computes and
writes what its items touch, the stream keeps no state of its own, and a
replayed batch adds nothing.

The payload is then made from the table's totals, days and categories (never
from the day-and-category rows, which only grow the table) and written as one
version, so a reader sees all sections of one refresh together. Its daily
section lists every day, as the reference's does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderpulse.operators import topk
from orderpulse.operators.kpis import COMPLETE_ITEMS, complete_items, kpi_summary_from_partials
from orderpulse.operators.measures import N_ITEMS, SALES, SALES_N, with_item_measures
from orderpulse.sinks.tables import KeyedTable, VersionedTable
from orderpulse.streaming.loaders import run_id

DEFAULT_REFRESH = "5 seconds"

#: what a row of the measures table sums up
ALL, DAY, CATEGORY, DAY_CATEGORY = "all", "day", "category", "day and category"
GRAIN_KEY = ["grain", "Working_Date", "Category"]
MEASURE_SUMS = [N_ITEMS, SALES, SALES_N, COMPLETE_ITEMS]
MEASURES_SCHEMA = (f"grain string, Working_Date date, Category string, {N_ITEMS} long, {SALES} decimal(38,0), "
                   f"{SALES_N} long, {COMPLETE_ITEMS} long")


def dashboard_deltas(items: DataFrame, amount: str = "grand_total") -> DataFrame:
    """The measures of item rows by grain: of all rows, per day, per category,
    per day and category. A null day or category is a key of its own."""
    m = with_item_measures(items, amount).withColumn(COMPLETE_ITEMS, complete_items("status"))
    sets = m.groupingSets([[], ["Working_Date"], ["Category"], ["Working_Date", "Category"]], "Working_Date", "Category").agg(
        F.grouping_id().alias("_set"), *[F.sum(c).alias(c) for c in MEASURE_SUMS])
    grain = F.element_at(F.array(*[F.lit(g) for g in (DAY_CATEGORY, DAY, CATEGORY, ALL)]), (F.col("_set") + 1).cast("int"))
    rows = sets.where(F.col(N_ITEMS) > 0)  # the grand total of no rows at all
    return rows.select(
        grain.alias("grain"), F.col("Working_Date").cast("date").alias("Working_Date"), F.col("Category").cast("string").alias("Category"),
        F.col(N_ITEMS).cast("long").alias(N_ITEMS), F.col(SALES).cast("decimal(38,0)").alias(SALES),
        F.col(SALES_N).cast("long").alias(SALES_N), F.col(COMPLETE_ITEMS).cast("long").alias(COMPLETE_ITEMS))


def add_measures(current: DataFrame, deltas: DataFrame) -> DataFrame:
    """Sums of both by key; an amount that was never there stays null."""
    both = current.select(*GRAIN_KEY, *MEASURE_SUMS).unionByName(deltas)
    return both.groupBy(*GRAIN_KEY).agg(
        *[F.sum(c).cast("decimal(38,0)" if c == SALES else "long").alias(c) for c in MEASURE_SUMS])


def measures_table(table: VersionedTable, buckets: int = 8) -> KeyedTable:
    """The table of measures that belongs to a payload table."""
    spark = table.spark
    schema = spark.createDataFrame([], MEASURES_SCHEMA).schema
    return KeyedTable(spark, f"{table.root}/measures", schema, GRAIN_KEY, buckets=buckets)


def payload_sections(measures: DataFrame, top_n: int = 5) -> DataFrame:
    """(section, payload JSON) rows from the measures: KPIs over everything,
    orders per day (null day dropped), top categories (null dropped)."""
    k = kpi_summary_from_partials(measures.where(F.col("grain") == ALL))
    kpi_row = k.select(F.lit("kpis").alias("section"), F.to_json(F.struct(*k.columns)).alias("payload"))
    daily = (measures.where((F.col("grain") == DAY) & F.col("Working_Date").isNotNull())
             .agg(F.sort_array(F.collect_list(F.struct("Working_Date", F.col(N_ITEMS).alias("orders")))).alias("v")))
    daily_row = daily.select(F.lit("daily_orders").alias("section"), F.to_json("v").alias("payload"))
    top = (topk.top_categories(measures.where(F.col("grain") == CATEGORY), n=top_n)
           .agg(F.sort_array(F.collect_list(F.struct("rank", "Category", "total"))).alias("v")))
    top_row = top.select(F.lit("top_categories").alias("section"), F.to_json("v").alias("payload"))
    return kpi_row.unionByName(daily_row).unionByName(top_row)


def refresh(batch: DataFrame, table: VersionedTable, measures: KeyedTable, tag: str, top_n: int = 5) -> int | None:
    """Add one batch of items and publish the payload. Returns the number of
    buckets of measures written, None for a batch that was added before."""
    deltas = dashboard_deltas(batch).persist()
    try:
        written = measures.merge(deltas, add_measures, tag)
        now = measures.read().where(F.col("grain") != DAY_CATEGORY)
        table.write_version(payload_sections(now, top_n), tag)
        return written
    finally:
        deltas.unpersist()


def start_dashboard_stream(items: DataFrame, table: VersionedTable, checkpoint: str,
                           refresh_every: str = DEFAULT_REFRESH, available_now: bool = False,
                           top_n: int = 5, measures: KeyedTable | None = None) -> StreamingQuery:
    """Keep the payload table current as items arrive (one version per trigger)."""
    measures = measures or measures_table(table)

    def run(batch: DataFrame, batch_id: int) -> None:
        refresh(batch, table, measures, f"{run_id(batch.sparkSession, checkpoint)} {batch_id}", top_n)

    w = items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=refresh_every)
    return w.start()


def read_kpis(table: VersionedTable) -> DataFrame:
    """The KPI section of the committed payload as columns."""
    schema = ("total_orders long, total_sales double, avg_order_value double, "
              "avg_order_value_page double, complete_rate double")
    k = table.read().where(F.col("section") == "kpis").select(F.from_json("payload", schema).alias("k"))
    return k.select("k.*")


def read_top_categories(table: VersionedTable) -> DataFrame:
    """The top-categories section of the committed payload as rows."""
    schema = "array<struct<rank:long,Category:string,total:double>>"
    t = table.read().where(F.col("section") == "top_categories")
    return t.select(F.explode(F.from_json("payload", schema)).alias("t")).select("t.*")
