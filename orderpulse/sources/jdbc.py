"""Relational table reads (SRC-07).

Aggregates are computed in Spark over a partitioned read; give
``partition_column`` with bounds so the scan is split across tasks instead
of one connection reading the whole table. ``query`` pushes a statement
(for example a pre-aggregation) down to the database instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str | None = None,
              query: str | None = None, properties: dict[str, str] | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None) -> DataFrame:
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    reader = spark.read.format("jdbc").option("url", url)
    reader = reader.option("dbtable", table) if table else reader.option("query", query)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        if table is None:
            raise ValueError("partitioned reads need a table, not a query")
        if lower_bound is None or upper_bound is None:
            raise ValueError("partitioned reads need lower_bound and upper_bound")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound))
                  .option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 8)))
    return reader.load()


def equal_predicates(column: str, histogram: list[tuple[int, int]], partitions: int, literal=str) -> list[str]:
    """Conditions on ``column`` that split a table into about equal parts, from
    a histogram [(lower end of a cell, rows in it)]. Each row satisfies exactly
    one: nulls have a condition of their own, the first range is open below
    and the last above, so rows that arrive outside the counted span are read
    as well. One cell is never split, however many rows it holds."""
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    total = sum(n for _, n in histogram)
    cuts, filled = [], 0
    for low, n in sorted(histogram):
        if filled and (len(cuts) + 1) * total <= filled * partitions:
            cuts.append(low)
        filled += n
    out = [f"{column} IS NULL"]
    if not cuts:
        return [*out, f"{column} IS NOT NULL"]
    out.append(f"{column} < {literal(cuts[0])}")
    out += [f"{column} >= {literal(a)} AND {column} < {literal(b)}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [*out, f"{column} >= {literal(cuts[-1])}"]


def histogram_query(table: str, column: str, low: int, high: int, cells: int) -> str:
    """The statement that counts rows by cell of a numeric ``column`` in the database."""
    width = max(1, -(-(high - low + 1) // cells))
    cell = f"FLOOR(({column} - {low}) / {width})"
    return (f"SELECT {low} + {width} * {cell} AS low, COUNT(*) AS n FROM {table} "
            f"WHERE {column} IS NOT NULL GROUP BY {cell}")


def read_jdbc_balanced(spark: SparkSession, url: str, table: str, column: str, partitions: int = 32,
                       properties: dict[str, str] | None = None, cells_per_partition: int = 16) -> DataFrame:
    """The whole table in partitions of about equal numbers of rows by a whole-
    number ``column``: its span and its histogram are counted in the database
    (one row, and at most ``partitions * cells_per_partition`` rows), so no
    bounds need to be known, and a lopsided key does not make one task read
    most of the table."""
    span = read_jdbc(spark, url, query=f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}", properties=properties).first()
    histogram = []
    if span[0] is not None:
        query = histogram_query(table, column, int(span[0]), int(span[1]), partitions * cells_per_partition)
        histogram = [(int(r[0]), int(r[1])) for r in read_jdbc(spark, url, query=query, properties=properties).collect()]
    return spark.read.jdbc(url, table, predicates=equal_predicates(column, histogram, partitions), properties=properties or {})
