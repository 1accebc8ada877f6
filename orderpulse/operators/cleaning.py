"""Parsing and validation of item messages (PRJ-02…05, FLT-01…07).

Every function maps a DataFrame with a string ``value`` column to rows; the
same code runs on a batch DataFrame and on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.json import is_wellformed_json, json_path
from orderpulse.functions.text import is_present, py_strip, strict_long

REASON_OK = "ok"
REASON_MALFORMED = "malformed"
REASON_NO_CATEGORY = "missing_category"
REASON_BAD_ID = "bad_item_id"
REASON_TOMBSTONE = "tombstone"


def parse_item_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """``$.item_id`` and ``$.Category`` as strings; missing key or malformed
    JSON gives null (PRJ-01/02)."""
    v = F.col(value).cast("string")
    return messages.select(
        json_path(v, "$.item_id").alias("item_id"),
        json_path(v, "$.Category").alias("Category"),
    )


def valid_categories(parsed: DataFrame, category: str = "Category") -> DataFrame:
    """Keep rows whose category is present: not null and not empty (FLT-01).

    This is the filter the reference intended; as written there, operator
    precedence turned it into a comparison of a boolean with ``""``.
    """
    return parsed.where(is_present(category))


def clean_item_rows(df: DataFrame, item_id: str = "item_id", category: str = "Category",
                    strict_ids: bool = False) -> DataFrame:
    """Strip categories (Python semantics), drop empty ones, cast ids.

    ``strict_ids`` fails the job on a bad id; otherwise a
    bad id becomes null (use :func:`classify_messages` to quarantine it).
    """
    iid = strict_long(item_id, "item_id") if strict_ids else F.col(item_id).try_cast("long")
    out = df.select(iid.alias("item_id"), py_strip(category).alias("Category"))
    return valid_categories(out)


def classify_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Every message with its parse result and a ``reason``:
    ok, tombstone, malformed, missing_category, bad_item_id.

    One pass; callers split on ``reason`` (FLT-05/07). Nothing is dropped
    here, so quarantining keeps the original text.
    """
    v = F.col(value).cast("string")
    raw_id = json_path(v, "$.item_id")
    cat = py_strip(json_path(v, "$.Category"))
    iid = raw_id.try_cast("long")
    reason = (F.when(v.isNull(), F.lit(REASON_TOMBSTONE))
              .when(~is_wellformed_json(v), F.lit(REASON_MALFORMED))
              .when(~is_present(cat), F.lit(REASON_NO_CATEGORY))
              .when(raw_id.isNotNull() & iid.isNull(), F.lit(REASON_BAD_ID))
              .otherwise(F.lit(REASON_OK)))
    return messages.select("*", iid.alias("item_id"), cat.alias("Category"), reason.alias("reason"))


def result_rows(counts: DataFrame, category: str = "Category", count: str = "count") -> DataFrame:
    """Rename and cast the running count for output: ``key``, ``value`` (PRJ-03)."""
    return counts.select(F.col(category).alias("key"), F.col(count).cast("string").alias("value"))


def result_counts(rows: DataFrame) -> DataFrame:
    """``key``/``value`` rows back to ``Category`` and integer ``count``, keeping
    only rows with both present (FLT-02, PRJ-13). The count is checked as
    text, so ``"0"`` is present and kept; only a missing or empty one drops
    the row."""
    out = rows.select(F.col("key").alias("Category"), F.col("value").try_cast("long").alias("count"))
    return out.where(is_present("Category") & F.col("count").isNotNull())
