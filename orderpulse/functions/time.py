"""Epoch-second conversions that do not depend on the session time zone.

The reference turns epoch seconds into the process's local wall clock; we
fix that clock to UTC and express it as ``timestamp_ntz`` arithmetic, so the
result is the same on every executor whatever its zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_utc(epoch_seconds: str | Column) -> Column:
    """Epoch seconds → UTC wall-clock ``timestamp_ntz``."""
    return F.timestamp_add("SECOND", _col(epoch_seconds).cast("long"), F.expr(EPOCH_NTZ))


def utc_to_epoch(ts_ntz: str | Column) -> Column:
    """UTC wall-clock ``timestamp_ntz`` → whole epoch seconds (truncated)."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH_NTZ), _col(ts_ntz))


def to_date(ts: str | Column) -> Column:
    return _col(ts).cast("date")
