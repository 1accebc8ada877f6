"""The table page's row listing over the 19-column order-item table.

One projection and one filter, no shuffle: rows without an item id are
skipped (FLT-04), the category defaults to ``N/A`` (PRJ-09), each row gets
its status style (PRJ-10), and the nine listed columns are kept (PRJ-11).
Works on typed or raw (all-string) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.labels import severity
from orderpulse.functions.text import category_or_default, is_present
from orderpulse.schemas import LISTING_COLUMNS


def table_page_rows(items: DataFrame) -> DataFrame:
    """Listed columns plus ``severity`` for every row that has an item id."""
    cols = []
    for c in LISTING_COLUMNS:
        cols.append(category_or_default(c).alias(c) if c == "Category" else F.col(c))
    present = is_present(F.col("item_id").cast("string"))
    return items.where(present).select(*cols, severity("status").alias("severity"))
