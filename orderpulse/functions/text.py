"""Text helpers: Python-style strip, empty checks, display defaults.

All are built-in column expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()),
# in code-point order: U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE_CHARS = "".join(
    [chr(c) for c in range(0x09, 0x0E)] + [chr(c) for c in range(0x1C, 0x21)]
    + ["\x85", "\xa0", "\u1680"] + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
)

# The class written for RE2 (DuckDB), used by oracle SQL.
PY_WHITESPACE_CLASS_RE2 = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

MISSING_CATEGORY = "N/A"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Strip leading/trailing whitespace exactly as Python's ``str.strip()``.

    ``trim(BOTH chars FROM c)`` with Python's whitespace set: no regular
    expression, one pass from each end. Plain ``trim`` only removes spaces; tabs, U+3000 and \\x1c-\\x1f survive it.
    Null stays null (the reference turned a missing field into the text
    ``None``; we keep it null so the empty-category filter removes it).
    """
    return F.trim(_col(c), F.lit(PY_WHITESPACE_CHARS))


def is_present(c: str | Column) -> Column:
    """Not null and not the empty string (the intended category filter)."""
    col = _col(c)
    return col.isNotNull() & (col != F.lit(""))


def category_or_default(c: str | Column, default: str = MISSING_CATEGORY) -> Column:
    """Missing or empty category shown as ``N/A``."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def strict_long(c: str | Column, what: str = "value") -> Column:
    """Integer cast that fails the job on a non-integer value, whatever the
    session's ANSI setting (null stays null)."""
    col = _col(c)
    parsed = col.try_cast("long")
    bad = col.isNotNull() & parsed.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"invalid {what}: "), col.cast("string")))
                  ).otherwise(parsed)
