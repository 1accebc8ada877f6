"""Source and sink round trips over the supplied tables.

Each query writes a table-derived file into a fresh folder under the
session's checkpoint root and reads it back with the reader under test, so
the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.sinks.messages import item_messages, plain_messages, write_message_files
from orderpulse.sources.files import read_message_files, read_named_csv, read_positional_csv
from orderpulse.session import scratch_path
from orderpulse.sources.tables import read_table


def csv_header_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01/04: a headed CSV with extra columns; named fields read back."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    path = scratch_path(spark, "csv-header")
    (ev.select(F.col("event_id").alias("item_id"), "ts", "user_id",
               F.col("event_type").alias("Category"), "value")
     .write.option("header", True).csv(path))
    named = read_named_csv(spark, path, ["item_id", "Category"])
    return named.select(F.col("item_id").cast("long").alias("item_id"), "Category")


def csv_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, SNK-02: a 10-column user log whose column 9 is read by
    position; the header row is dropped by value; values are published as
    plain-text messages and read back."""
    cu = read_table(spark, sf_dir, "customer",
                    ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    log = cu.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.lit("a").alias("c4"), F.lit("b").alias("c5"), F.lit("c").alias("c6"),
        F.lit("d").alias("c7"), F.lit("e").alias("c8"),
        F.col("c_mktsegment").alias("gender"),
    )
    path = scratch_path(spark, "csv-positional")
    log.write.option("header", True).csv(path)
    values = read_positional_csv(spark, path, 9, header_value="gender")
    out = scratch_path(spark, "plain-messages")
    write_message_files(plain_messages(values, "value"), out)
    return read_message_files(spark, out)


def csv_quoted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: document texts with quotes, commas and line breaks added,
    written to RFC 4180 and read back whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch_path(spark, "csv-quoted")
    quoted = F.concat(F.lit('he said "x", ok\n'), F.col("text"), F.lit(',"'))
    (docs.select(F.col("doc_id").alias("item_id"), quoted.alias("Category"), F.lit("z").alias("last"))
     .write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    rows = read_named_csv(spark, path, ["item_id", "Category", "last"], multi_line=True)
    return rows.select(F.col("item_id").cast("long").alias("item_id"), F.sha2("Category", 256).alias("sha"), "last")


def ensured_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-09: a table that is made empty with its schema when it is missing,
    left alone when it is there; rows before and after an append."""
    from orderpulse.schemas import CATEGORY_COUNT
    from orderpulse.sinks.tables import ensure_table

    path = scratch_path(spark, "ensured")
    ev = read_table(spark, sf_dir, "events", ["event_type"])
    counts = ev.groupBy(F.col("event_type").alias("Category")).agg(F.count(F.lit(1)).alias("count"))
    ensure_table(spark, path, CATEGORY_COUNT)
    empty = spark.read.parquet(path).count()
    counts.write.mode("append").parquet(path)
    ensure_table(spark, path, CATEGORY_COUNT)
    return spark.read.parquet(path).select(F.lit(empty).cast("long").alias("rows_before"), "Category", "count")


def publish_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, PRJ-06: ``{"item_id", "Category"}`` messages per event, written
    as message files and read back as text."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    msgs = item_messages(ev.select(F.col("event_id").alias("item_id"),
                                   F.col("event_type").alias("Category")))
    out = scratch_path(spark, "json-messages")
    write_message_files(msgs, out)
    return read_message_files(spark, out)


def export_order_items(spark: SparkSession, sf_dir: str, path: str,
                       max_records_per_file: int | None = None, fmt: str = "csv") -> None:
    """Write the item fact as the 19-column order-item table: CSV with a
    header (the reference's file), or Parquet.

    Columns whose meaning is unknown (bi_status, mv, month_year,
    fiscal_year, month_name) are written empty rather than invented;
    ``item_id`` is ``l_orderkey * 100 + l_linenumber``, a line id that the
    KPIs do not use.
    """
    from orderpulse.plans.fact import item_fact
    from orderpulse.schemas import MONEY, ORDER_ITEM

    f = item_fact(spark, sf_dir)
    null = F.lit(None).cast("string")
    out = f.select(
        (F.col("increment_id") * 100 + F.col("line_number")).alias("item_id"),
        "status",
        F.col("created_at").cast("timestamp").alias("created_at"),
        "price", "qty_ordered", "grand_total",
        F.col("increment_id").cast("string").alias("increment_id"),
        "Category",
        (F.col("price") - F.col("grand_total")).cast(MONEY).alias("discount_amount"),
        "payment_method", "Working_Date",
        null.alias("bi_status"), null.alias("mv"),
        F.year("Working_Date").alias("year"), F.month("Working_Date").alias("month"),
        null.alias("month_year"), null.alias("fiscal_year"),
        "Customer_ID", null.alias("month_name"),
    )
    assert out.columns == ORDER_ITEM.names
    w = out.write
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")


def _typed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderpulse.operators.measures import with_item_measures
    from orderpulse.sources.files import read_typed_csv

    path = scratch_path(spark, "order-items-csv")
    export_order_items(spark, sf_dir, path)
    return with_item_measures(read_typed_csv(spark, path))


def csv_page_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, AGG-02…05 page form: the home page's KPIs from the typed CSV."""
    from orderpulse.operators import kpis

    return kpis.kpi_summary(_typed_items(spark, sf_dir))


def csv_page_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07 page form (null categories dropped) from the typed CSV."""
    from orderpulse.operators import topk

    return topk.top_categories(_typed_items(spark, sf_dir), n=5, drop_null_keys=True)


def csv_raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, FLT-04, PRJ-09…11: the table page read as untyped string rows;
    rows without an item id are skipped, the category defaults to ``N/A``
    and each row gets its status style. The columns whose text is Spark's
    own formatting (timestamps, decimals) are left out of the result."""
    from orderpulse.operators.listing import table_page_rows
    from orderpulse.sources.files import read_raw_csv

    path = scratch_path(spark, "order-items-raw")
    export_order_items(spark, sf_dir, path)
    rows = table_page_rows(read_raw_csv(spark, path))
    return rows.select("item_id", "status", "severity", "Category", "payment_method", "Customer_ID")
