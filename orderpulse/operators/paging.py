"""Paged listings (LIM-01) and page metadata (LIM-02).

Two exact ways to fetch page ``p`` of ``per_page`` rows, ordered by a key and
tie-break columns, nulls first:

* :func:`page_rows` finds any page. The rows before the page are skipped in
  rounds: the range of the first order column that still holds the page is
  cut at sampled values, an exact count per sub-range (at most ``fanout``
  rows to the driver) says which of them hold the page, and the offset loses
  the rows before them. Nulls are a range of their own, the first. A range of
  one value is cut by the next order column. Once at most ``window`` rows lie
  before the end of the page, ``orderBy.offset.limit`` finishes, planned as
  ``TakeOrderedAndProject``. How many rounds run does not change the page,
  and any orderable type can be the key.
* :func:`page_after` is the keyset page: ``key > last_key``, then the first
  ``per_page``. The filter reaches the Parquet reader. This is the
  recommended way to walk a large table.

Bounds keep the key's type, so they reach the Parquet reader as well, and the
narrowing can read a cheaper frame than the listing (``keys``), for example
the key column of the largest table instead of a join.

Pages are 1-based; a page beyond the end is empty; ``page < 1`` or
``per_page < 1`` is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PER_PAGE = 25
DEFAULT_WINDOW = 10_000
DEFAULT_FANOUT = 128
SAMPLE_PER_RANGE = 32


def _check(page: int, per_page: int) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if per_page < 1:
        raise ValueError("per_page must be at least 1")


def page_rows(df: DataFrame, key: str, page: int = 1, per_page: int = DEFAULT_PER_PAGE,
              window: int = DEFAULT_WINDOW, fanout: int = DEFAULT_FANOUT,
              tiebreak: list[str] | tuple[str, ...] = (), keys: DataFrame | None = None) -> DataFrame:
    """Rows of 1-based ``page`` ordered by ``key``, then by ``tiebreak``.

    Give tie-break columns that make the order total (or cover every output
    column, so that tied rows are identical) for a deterministic page.
    ``keys`` holds the same values of ``key`` as ``df``, row for row, and is
    read instead of it while narrowing on the key.
    """
    _check(page, per_page)
    order = [key, *tiebreak]
    by = [F.col(c).asc_nulls_first() for c in order]
    pieces = _pieces(df, keys, order, (page - 1) * per_page, per_page, max(window, per_page), max(2, fanout))
    found = [(df if cond is None else df.where(cond)).orderBy(*by).offset(skip).limit(take)
             for cond, skip, take in pieces]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out if len(found) == 1 else out.orderBy(*by)


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def _index_of(key: Column, cuts: list[Column]) -> Column:
    """Number of ``cuts`` (sorted) at or below ``key``, by bisection."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= cuts[mid], search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, len(cuts))


def _ranges(k: Column, cuts: list[Column]) -> tuple[Column, list[tuple[Column, bool]]]:
    """(number of a row's range, [(range, whether it is one value)]) in order.
    A single cut value gets a range of its own."""
    if len(cuts) == 1:
        at = F.when(k.isNull(), 0).when(k < cuts[0], 1).when(k == cuts[0], 2).otherwise(3)
        return at, [(k.isNull(), True), (k < cuts[0], False), (k == cuts[0], True), (k > cuts[0], False)]
    at = F.when(k.isNull(), F.lit(0)).otherwise(_index_of(k, cuts) + 1)
    inner = [((k >= a) & (k < b), False) for a, b in zip(cuts, cuts[1:], strict=False)]
    return at, [(k.isNull(), True), (k < cuts[0], False), *inner, (k >= cuts[-1], False)]


def _pieces(df: DataFrame, keys: DataFrame | None, order: list[str], skip: int, take: int, window: int,
            fanout: int) -> list[tuple[Column | None, int, int]]:
    """(range, rows to skip in it, rows to take): one, or two when the page
    begins at the end of a range that holds very many rows."""
    cond: Column | None = None
    later: list[tuple[Column | None, int, int]] = []
    for column in order:
        k, kind = F.col(column), df.schema[column].dataType
        source = keys if keys is not None and column == order[0] else df
        while skip + take > window:
            rows = source if cond is None else source.where(cond)
            cuts = _cuts(rows, column, fanout)
            if not cuts:
                break  # nulls only: the next column orders them
            at, ranges = _ranges(k, [F.lit(c).cast(kind) for c in cuts])
            counts = sorted((r["b"], r["n"]) for r in rows.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
            passed, first, size = 0, None, 0
            for b, n in counts:
                if passed + n > skip:
                    first, size = b, n
                    break
                passed += n
            if first is None:  # the page lies beyond the end
                return [(F.lit(False), 0, take)]
            skip -= passed
            if size - skip < take and first < len(ranges) - 1:
                after = ranges[first + 1][0]
                for r, _ in ranges[first + 2:]:
                    after = after | r
                later.append((_both(cond, after), 0, take - (size - skip)))
                take = size - skip
            cond = _both(cond, ranges[first][0])
            if ranges[first][1]:
                break  # one value: the next column cuts it
    return [(cond, skip, take), *reversed(later)]


def _cuts(rows: DataFrame, column: str, fanout: int) -> list:
    """At most ``fanout`` sorted, distinct, non-null values that cut the rows
    into about equal ranges, from a small random sample."""
    sampled = rows.where(F.col(column).isNotNull()).select(column, F.rand(17).alias("_r"))
    values = sorted(r[0] for r in sampled.orderBy("_r").limit(fanout * SAMPLE_PER_RANGE).select(column).collect())
    return sorted({values[i * len(values) // fanout] for i in range(fanout)}) if values else []


def page_after(df: DataFrame, key: str, after_key=None, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
    """Keyset page: the first ``per_page`` rows with ``key > after_key``."""
    _check(1, per_page)
    if after_key is not None:
        df = df.where(F.col(key) > F.lit(after_key))
    return df.orderBy(F.col(key).asc()).limit(per_page)


def page_metadata(df: DataFrame, page: int = 1, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
    """One row: page, per_page, total, total_pages, start_page, end_page.

    ``total_pages = ceil(total / per_page)``; the page-number band is
    ``max(1, page-2)`` … ``min(total_pages, page+2)``.
    """
    _check(page, per_page)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / F.lit(per_page)).cast("long")
    return total.select(
        F.lit(page).cast("long").alias("page"),
        F.lit(per_page).cast("long").alias("per_page"),
        F.col("total").cast("long").alias("total"),
        pages.alias("total_pages"),
        F.greatest(F.lit(1), F.lit(page - 2)).cast("long").alias("start_page"),
        F.least(pages, F.lit(page + 2)).cast("long").alias("end_page"),
    )
