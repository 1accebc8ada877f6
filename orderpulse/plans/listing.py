"""Paged order listings over ``orders`` (unique key ``o_orderkey``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.functions.labels import severity
from orderpulse.operators import page_index, paging
from orderpulse.plans.fact import order_dimension
from orderpulse.session import scratch_path
from orderpulse.sources.tables import read_table

# Fixed parameters of the registered page queries.
PAGE = 3
DEEP_PAGE = 401
ITEM_PAGE = 1001
AFTER_KEY = 9_999
PER_PAGE = paging.DEFAULT_PER_PAGE


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_dimension(spark, sf_dir)
    return o.select(
        F.col("o_orderkey").alias("item_id"), "status", severity("status").alias("severity"),
        "created_at", F.col("order_total").alias("grand_total"), "payment_method", "Customer_ID",
    )


def order_page(spark: SparkSession, sf_dir: str, page: int = PAGE, per_page: int = PER_PAGE) -> DataFrame:
    """LIM-01, shallow page: top-k by key then offset."""
    return paging.page_rows(order_rows(spark, sf_dir), "item_id", page, per_page)


def order_page_deep(spark: SparkSession, sf_dir: str, page: int = DEEP_PAGE,
                    per_page: int = PER_PAGE) -> DataFrame:
    """LIM-01, deep page: the key column is narrowed first (a small final
    window makes the rounds run on small tables, too)."""
    return paging.page_rows(order_rows(spark, sf_dir), "item_id", page, per_page, window=per_page * 4, fanout=16)


def null_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order rows with every 20th key null and, for the order of those,
    the key itself as ``item_no``."""
    rows = order_rows(spark, sf_dir)
    key = F.col("item_id")
    return rows.select(F.when(key % 20 != 0, key).alias("item_id"), key.alias("item_no"), "status", "grand_total")


def order_page_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-01 with null keys, which come first: a page found in one step and
    the same page, and a deep one, found by narrowing."""
    rows = null_key_rows(spark, sf_dir)

    def page(name: str, number: int, window: int) -> DataFrame:
        found = paging.page_rows(rows, "item_id", number, PER_PAGE, window=window, fanout=8, tiebreak=["item_no"])
        return found.select(F.lit(name).alias("path"), "*")

    return (page("one step", PAGE, paging.DEFAULT_WINDOW).unionAll(page("narrowed", PAGE, PER_PAGE))
            .unionAll(page("deep", DEEP_PAGE, PER_PAGE * 4)))


#: rows in a file of the page index of order_page_indexed: small, so that pages cross files on small tables, too
INDEX_FILE_ROWS = 1_010


def order_page_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-01 from a page index over the rows of ``order_page_nulls``: a page
    among the null keys, a deep one, one across two files, and one beyond the end."""
    rows = null_key_rows(spark, sf_dir)
    root = scratch_path(spark, "page-index")
    page_index.write_page_index(rows, root, "item_id", ["item_no"], rows_per_file=INDEX_FILE_ROWS)

    def page(number: int) -> DataFrame:
        found = page_index.indexed_page(spark, root, rows.schema, number, PER_PAGE)
        return found.select(F.lit(number).cast("long").alias("page"), "*")

    return page(PAGE).unionAll(page(DEEP_PAGE)).unionAll(page(INDEX_FILE_ROWS // PER_PAGE + 1)).unionAll(page(10 ** 12))


def order_page_after(spark: SparkSession, sf_dir: str, after_key: int = AFTER_KEY,
                     per_page: int = PER_PAGE) -> DataFrame:
    """Keyset page: the rows after a known key."""
    return paging.page_after(order_rows(spark, sf_dir), "item_id", after_key, per_page)


def page_metadata(spark: SparkSession, sf_dir: str, page: int = PAGE, per_page: int = PER_PAGE) -> DataFrame:
    """LIM-02: total, total pages and the page-number band."""
    return paging.page_metadata(order_rows(spark, sf_dir), page, per_page)


ITEM_COLUMNS = ["increment_id", "line_number", "status", "created_at", "price", "qty_ordered",
                "grand_total", "Category", "payment_method", "Customer_ID"]


def item_page(spark: SparkSession, sf_dir: str, page: int = ITEM_PAGE, per_page: int = PER_PAGE) -> DataFrame:
    """LIM-01 over item rows, as the table page lists them: ordered by the
    order key, ties broken by every other listed column (the line key is not
    unique in the supplied data, so identical rows may tie, and they are
    interchangeable). Narrowing reads ``l_orderkey`` alone; the joins run
    once, over the rows of the final range."""
    from orderpulse.plans.fact import item_fact

    keys = read_table(spark, sf_dir, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("increment_id"))
    f = item_fact(spark, sf_dir).select(
        "increment_id", "line_number", "status", "created_at",
        F.col("price").cast("double").alias("price"), "qty_ordered",
        F.col("grand_total").cast("double").alias("grand_total"),
        "Category", "payment_method", "Customer_ID")
    return paging.page_rows(f, "increment_id", page, per_page, tiebreak=ITEM_COLUMNS[1:], keys=keys)
