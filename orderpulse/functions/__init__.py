"""Column-expression helpers (all built-in Spark functions, no UDFs)."""

from orderpulse.functions.display import fixed2, money, percent1
from orderpulse.functions.json import (
    bytes_to_string,
    is_wellformed_json,
    json_path,
    snapshot_entries,
    snapshot_shape,
    to_json_row,
)
from orderpulse.functions.labels import STATUS_SEVERITY, is_complete, severity
from orderpulse.functions.text import category_or_default, is_present, py_strip
from orderpulse.functions.time import epoch_to_utc, to_date, utc_to_epoch

__all__ = [
    "STATUS_SEVERITY", "bytes_to_string", "category_or_default", "epoch_to_utc",
    "fixed2", "is_complete", "is_present", "is_wellformed_json", "json_path",
    "money", "percent1", "py_strip", "severity", "snapshot_entries",
    "snapshot_shape", "to_date", "to_json_row", "utc_to_epoch",
]
