"""Status vocabularies: order status names and their display severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three known order statuses and the row style each gets
# on the table page.
STATUS_SEVERITY = {
    "complete": "success",
    "canceled": "danger",
    "order_refunded": "warning",
}

COMPLETE = "complete"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity(status: str | Column) -> Column:
    """Status → ``success`` / ``danger`` / ``warning``; anything else → null."""
    s = _col(status)
    expr = None
    for name, label in STATUS_SEVERITY.items():
        expr = F.when(s == name, label) if expr is None else expr.when(s == name, label)
    return expr.otherwise(F.lit(None).cast("string"))


def is_complete(status: str | Column) -> Column:
    """Case-sensitive equality with ``complete``; null status is not complete."""
    return F.coalesce(_col(status) == F.lit(COMPLETE), F.lit(False))
