"""Explicit schemas for the order-item fact, the messages and the payloads."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

# The 19-column order-item table, in display order. Columns without a known
# meaning (bi_status, mv, fiscal_year) are carried as opaque strings.
ORDER_ITEM = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("price", MONEY),
    T.StructField("qty_ordered", T.IntegerType()),
    T.StructField("grand_total", MONEY),
    T.StructField("increment_id", T.StringType()),
    T.StructField("Category", T.StringType()),
    T.StructField("discount_amount", MONEY),
    T.StructField("payment_method", T.StringType()),
    T.StructField("Working_Date", T.DateType()),
    T.StructField("bi_status", T.StringType()),
    T.StructField("mv", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("month_year", T.StringType()),
    T.StructField("fiscal_year", T.StringType()),
    T.StructField("Customer_ID", T.LongType()),
    T.StructField("month_name", T.StringType()),
])

# The nine columns of the table page listing.
LISTING_COLUMNS = [
    "item_id", "status", "created_at", "price", "qty_ordered",
    "grand_total", "Category", "payment_method", "Customer_ID",
]

# Message published per order item: {"item_id": long, "Category": string}.
ITEM_MESSAGE = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("Category", T.StringType()),
])

CATEGORY_COUNT = T.StructType([
    T.StructField("Category", T.StringType()),
    T.StructField("count", T.LongType()),
])

# Snapshot envelope: {"timestamp": epoch s, "data": [{Category, count}]}.
# snapshot_id / part / parts are our additions so a large snapshot can be
# split over several bounded messages and reassembled exactly.
SNAPSHOT_ENVELOPE = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("snapshot_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("parts", T.IntegerType()),
    T.StructField("data", T.ArrayType(CATEGORY_COUNT)),
])

SNAPSHOT_ARRAY = T.ArrayType(CATEGORY_COUNT)

# Row of the keyed snapshot table (category_stats). ``timestamp`` is the
# snapshot's wall-clock time in UTC (the reference stored a naive local
# DATETIME); ``updated_at`` is the instant the row was written.
CATEGORY_STATS = T.StructType([
    T.StructField("category", T.StringType(), False),
    T.StructField("count", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampType()),
])

# Row of the quarantine table: the message text and why it was set aside.
QUARANTINE = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("reason", T.StringType()),
])
