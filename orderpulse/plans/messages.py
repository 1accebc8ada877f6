"""Message, text and display queries over the supplied tables.

Stream messages are derived from ``events`` exactly as the fixture mapping
says: ``{"item_id": event_id, "Category": event_type}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.functions.display import fixed2, money, percent1
from orderpulse.functions.json import json_path
from orderpulse.functions.labels import severity
from orderpulse.functions.text import category_or_default
from orderpulse.functions.time import epoch_to_utc, utc_to_epoch
from orderpulse.operators import kpis
from orderpulse.operators.cleaning import clean_item_rows, parse_item_messages
from orderpulse.operators.snapshot import (
    array_message, envelope_messages, explode_entries, object_messages, route_messages,
)
from orderpulse.plans.fact import item_fact, order_dimension, order_grain_fact
from orderpulse.sources.tables import read_table


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as item messages, keeping event_id alongside for checking."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    msg = F.to_json(F.struct(F.col("event_id").alias("item_id"),
                             F.col("event_type").alias("Category")))
    return ev.select("event_id", "props", msg.alias("value"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01/02: JSON path extraction from messages and from ``props``."""
    msgs = event_messages(spark, sf_dir)
    return msgs.select(
        "event_id",
        json_path("value", "$.item_id").alias("item_id"),
        json_path("value", "$.Category").alias("Category"),
        json_path("props", "$.k").alias("k"),
    )


# Fixed values for the padding test: ideographic space and tab before the
# category, space and U+001C after it. Python's str.strip() removes all four.
PAD_LEFT = "\u3000\t"
PAD_RIGHT = " \u001c"


def clean_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04/05, FLT-01: padded categories stripped with Python semantics,
    empty ones dropped, ids cast to long."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    padded = ev.select(
        F.to_json(F.struct(F.col("event_id").cast("string").alias("item_id"),
                           F.concat(F.lit(PAD_LEFT), F.col("event_type"), F.lit(PAD_RIGHT))
                           .alias("Category"))).alias("value"))
    return clean_item_rows(parse_item_messages(padded))


def status_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10: status → row style."""
    o = order_dimension(spark, sf_dir)
    return o.select(F.col("o_orderkey").alias("item_id"), "status",
                    severity("status").alias("severity"))


def item_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09/10/11: the table page's nine columns for every item, with the
    ``N/A`` category default and the status style. Money is shown as double
    (converted once from the exact decimal)."""
    f = item_fact(spark, sf_dir)
    return f.select(
        "increment_id", "line_number", "status", severity("status").alias("severity"),
        "created_at", F.col("price").cast("double").alias("price"), "qty_ordered",
        F.col("grand_total").cast("double").alias("grand_total"),
        category_or_default("Category").alias("Category"),
        "payment_method", "Customer_ID",
    )


def kpi_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-12: the home page's formatted KPI cards."""
    k = kpis.kpi_summary(order_grain_fact(spark, sf_dir))
    return k.select(
        F.col("total_orders"),
        fixed2("avg_order_value").alias("avg_order_value_text"),
        money("total_sales").alias("total_sales_text"),
        money("avg_order_value").alias("avg_order_value_money"),
        fixed2("complete_rate").alias("complete_rate_text"),
        percent1("complete_rate").alias("complete_rate_percent"),
    )


def epoch_to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08: event times to epoch seconds and back to a UTC timestamp."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    epoch = utc_to_epoch("ts")
    return ev.select("event_id", epoch.alias("epoch"), epoch_to_utc(epoch).alias("ts_utc"))


def payload_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05/06, PRJ-07, SNK-04/05: per-category counts of ``events``
    encoded in all three snapshot shapes, then routed and parsed back."""
    ev = read_table(spark, sf_dir, "events", ["event_type"])
    counts = ev.groupBy(F.col("event_type").alias("Category")).agg(F.count(F.lit(1)).alias("count"))
    tombstones = ev.groupBy("event_type").agg(F.lit(None).cast("string").alias("value")).select("value")
    msgs = (envelope_messages(counts, 1, 0, parts=3)
            .unionByName(array_message(counts))
            .unionByName(object_messages(counts)).unionByName(tombstones))
    rows = explode_entries(route_messages(msgs))
    return rows.select("shape", "route", "Category", F.col("count").cast("long").alias("count"))


def tombstone_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05/06: every tenth event's message is null; messages by route."""
    msgs = event_messages(spark, sf_dir).select(F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))
    return route_messages(msgs).groupBy("shape", "route").agg(F.count(F.lit(1)).alias("messages"))


def result_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14: orders per payment method as one map, read back by key."""
    from orderpulse.operators.distributions import as_map, payment_distribution

    grouped = payment_distribution(order_grain_fact(spark, sf_dir))
    return as_map(grouped, "payment_method", "orders").select(F.explode("map").alias("payment_method", "orders"))


def message_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01/02: messages as a broker delivers them (UTF-8 bytes in
    ``value``), decoded and parsed."""
    from orderpulse.functions.json import bytes_to_string
    from orderpulse.operators.cleaning import parse_item_messages

    raw = event_messages(spark, sf_dir).select(F.encode("value", "UTF-8").alias("value"))
    return parse_item_messages(raw.select(bytes_to_string("value").alias("value")))


def result_rows_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03/13, FLT-02: the running count per event type shaped as the
    job's ``key``/``value`` string rows, then read back as integer counts."""
    from orderpulse.operators.cleaning import result_counts, result_rows
    from orderpulse.streaming.category_count import category_counts

    counts = category_counts(event_messages(spark, sf_dir).select("value"))
    return result_counts(result_rows(counts))
