"""The sales fact over the supplied normalised tables.

Semantically the fact is one row per order item::

    sales = lineitem ⋈ orders (l_orderkey = o_orderkey)
                     ⋈ part   (l_partkey  = p_partkey)

with the reference's column names (``status``, ``Working_Date``,
``Category``, ``payment_method``, ``Customer_ID``, ``grand_total``).

Most dashboard metrics need only one dimension, and every metric is
additive (see ``orderpulse.operators.measures``), so the plans here
*aggregate lineitem to the join key first* and join the dimension after
(eager aggregation):

* :func:`order_grain_fact` – lineitem summed per ``l_orderkey``, then joined
  to ``orders``. The aggregate's output is already hash-partitioned by the
  key, so the join shuffles only ``orders``. Where the items of an order lie
  together, the lineitem shuffle carries partial sums; in unsorted data it is
  near the number of items, and ``orderpulse.plans.layout`` avoids it.
* :func:`category_grain_fact` – lineitem summed per ``l_partkey``, then
  joined to ``part``: roughly items/parts times fewer rows reach the join.

A key that holds a third of all items collapses to one partial row per map
task before any shuffle, so neither plan has a skewed join partition.

``order_grain`` / ``category_grain`` take the input frames, so the same plan
runs over the Parquet files (``*_fact``) or over a bucketed layout
(``orderpulse.plans.layout``), where the aggregate and the join need no
exchange at all.

Skipping the other dimension's join relies on foreign-key integrity (every
item's order and part exist), which TPC-H style data guarantees. Pass
``fk_integrity=False`` to keep the inner-join semantics on data that may
hold orphans: the missing dimension is then applied as a semi join.

No broadcast hints: Catalyst broadcasts a side only when its estimated size
is under ``spark.sql.autoBroadcastJoinThreshold``, and AQE converts a join to
broadcast only from measured shuffle sizes. Both checks grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.operators.measures import (
    MEASURES, N_ITEMS, SALES, SALES_N, UNITS_SUM_INPUT, partial_measures,
)
from orderpulse.schemas import MONEY
from orderpulse.sources.tables import read_table

# Fixed values (our fixture mapping): TPC-H order status codes to the
# reference's status names. F complete, O canceled, P order_refunded.
STATUS_CODES = {"F": "complete", "O": "canceled", "P": "order_refunded"}


def status_name(code: str | Column = "o_orderstatus") -> Column:
    c = F.col(code) if isinstance(code, str) else code
    expr = None
    for k, v in STATUS_CODES.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr.otherwise(F.lit(None).cast("string"))


def grand_total() -> Column:
    """Exact item amount: price × (1 − discount), both read as 2-dp decimals
    (for listings; aggregates use :func:`grand_total_units`)."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    return (price * (F.lit(1) - discount)).cast(MONEY)


def grand_total_units() -> Column:
    """The same amount as an exact ``long`` count of 1/10000 units:
    cents × (100 − discount percent). Primitive arithmetic inside whole-stage
    codegen, instead of a ``BigDecimal`` product per item; ``rint`` maps the
    2-dp doubles to their cent and percent integers."""
    cents = F.rint(F.col("l_extendedprice") * F.lit(100)).cast("long")
    percent = F.rint(F.col("l_discount") * F.lit(100)).cast("long")
    return cents * (F.lit(100) - percent)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                 "o_orderpriority", "o_totalprice"]


def order_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with the reference's column names, one row per order."""
    return order_columns(read_table(spark, sf_dir, "orders", ORDER_COLUMNS))


def order_columns(o: DataFrame) -> DataFrame:
    return o.select(
        F.col("o_orderkey"),
        status_name("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").cast("date").alias("Working_Date"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_custkey").alias("Customer_ID"),
        F.col("o_totalprice").alias("order_total"),
    )


def part_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_columns(read_table(spark, sf_dir, "part", ["p_partkey", "p_type"]))


def part_columns(p: DataFrame) -> DataFrame:
    return p.select("p_partkey", F.col("p_type").alias("Category"))


LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount"]


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem", LINEITEM_COLUMNS)


def order_grain(lineitem: DataFrame, orders: DataFrame,
                part_keys: DataFrame | None = None) -> DataFrame:
    """One row per order from given ``lineitem`` and ``orders`` frames (raw
    TPC-H columns); ``part_keys`` (``p_partkey``) applies the part join as a
    semi join when foreign keys are not trusted."""
    li = lineitem
    if part_keys is not None:
        li = li.join(part_keys, li.l_partkey == part_keys.p_partkey, "left_semi")
    per_order = li.groupBy("l_orderkey").agg(*partial_measures(grand_total_units()))
    o = order_columns(orders)
    joined = per_order.join(o, per_order.l_orderkey == o.o_orderkey, "inner")
    return joined.select("o_orderkey", "status", "created_at", "Working_Date",
                         "payment_method", "Customer_ID", *MEASURES)


def order_grain_fact(spark: SparkSession, sf_dir: str, fk_integrity: bool = True) -> DataFrame:
    """One row per order: order attributes + measures of its items."""
    part_keys = None if fk_integrity else read_table(spark, sf_dir, "part", ["p_partkey"])
    return order_grain(_lineitem(spark, sf_dir), read_table(spark, sf_dir, "orders", ORDER_COLUMNS),
                       part_keys)


def category_grain(lineitem: DataFrame, parts: DataFrame,
                   order_keys: DataFrame | None = None) -> DataFrame:
    """One row per part from given ``lineitem`` and ``part`` frames."""
    li = lineitem
    if order_keys is not None:
        li = li.join(order_keys, li.l_orderkey == order_keys.o_orderkey, "left_semi")
    per_part = li.groupBy("l_partkey").agg(*partial_measures(grand_total_units()))
    p = part_columns(parts)
    joined = per_part.join(p, per_part.l_partkey == p.p_partkey, "inner")
    return joined.select("p_partkey", "Category", *MEASURES)


def category_grain_fact(spark: SparkSession, sf_dir: str, fk_integrity: bool = True) -> DataFrame:
    """One row per part: its category + measures of its items."""
    order_keys = None if fk_integrity else read_table(spark, sf_dir, "orders", ["o_orderkey"])
    return category_grain(_lineitem(spark, sf_dir), read_table(spark, sf_dir, "part", ["p_partkey", "p_type"]),
                          order_keys)


def item_totals_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item rows with their measures and no dimension: totals over all items
    need no join and only the one-row exchange of their last step."""
    units = grand_total_units().cast(UNITS_SUM_INPUT)
    one = F.lit(1).cast("long")
    return _lineitem(spark, sf_dir).select(
        F.lit(None).cast("string").alias("status"), one.alias(N_ITEMS), units.alias(SALES),
        F.when(units.isNotNull(), one).otherwise(F.lit(0)).alias(SALES_N))


def item_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full item-level fact (both joins), for listings and item metrics."""
    li = _lineitem(spark, sf_dir)
    orders = order_dimension(spark, sf_dir)
    parts = part_dimension(spark, sf_dir)
    joined = (li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
              .join(parts, li.l_partkey == parts.p_partkey, "inner"))
    return joined.select(
        F.col("l_orderkey").alias("increment_id"),
        F.col("l_linenumber").alias("line_number"),
        "status", "created_at",
        F.col("l_extendedprice").cast("decimal(12,2)").cast(MONEY).alias("price"),
        F.col("l_quantity").cast("int").alias("qty_ordered"),
        grand_total().alias("grand_total"),
        "Category", "payment_method", "Working_Date", "Customer_ID",
        F.lit(1).cast("long").alias(N_ITEMS),
        grand_total_units().cast("decimal(38,0)").alias(SALES),
        F.lit(1).cast("long").alias(SALES_N),
    )
