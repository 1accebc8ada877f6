"""Display formatting of KPI values.

``format_number`` uses a DecimalFormat with half-even rounding of the exact
binary value, which matches Python's ``%.2f`` / ``{:,.2f}``; ``format_string``
(Java Formatter) rounds half-up on the shortest decimal form and differs on
values such as 2.675, so it is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The display formats of the home page.
CURRENCY_SYMBOL = "¥"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pattern(c: str | Column, pattern: str) -> Column:
    """SQL ``format_number(x, 'pattern')`` (DecimalFormat pattern form)."""
    return F.call_function("format_number", _col(c).cast("double"), F.lit(pattern))


def fixed2(c: str | Column) -> Column:
    """``"%.2f" % x``: two decimals, no grouping."""
    return _pattern(c, "0.00")


def money(c: str | Column) -> Column:
    """``"¥{:,.2f}".format(x)``: currency sign, thousands groups, two decimals."""
    return F.concat(F.lit(CURRENCY_SYMBOL), F.format_number(_col(c).cast("double"), 2))


def percent1(c: str | Column) -> Column:
    """``"{:.1f}%".format(x)``: one decimal and a percent sign."""
    return F.concat(_pattern(c, "0.0"), F.lit("%"))
