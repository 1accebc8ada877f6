"""A listing kept in page order, with an index of row numbers (LIM-01).

:func:`write_page_index` sorts a listing once, by range partitions, into files
of at most ``rows_per_file`` rows, and writes beside them an order-statistics
index: for each file the number of its first row. :func:`indexed_page` then
answers any page from the index and the one or two files that hold it, where
``page_rows`` scans the key once a round. Nulls come first and ties follow the
tie-break columns, as there; the pages are the same.

::

    rows/*.parquet       the rows, sorted within and between files
    index/*.parquet      (file, first_row, rows), one line a file

Identical rows are interchangeable, but order columns that tie for very many
rows put these into one range: give tie-break columns that make the order total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderpulse.operators.paging import DEFAULT_PER_PAGE, _check

ROWS_PER_FILE = 200_000
INDEX_SCHEMA = "file string, first_row long, rows long"


def write_page_index(df: DataFrame, root: str, key: str, tiebreak: list[str] | tuple[str, ...] = (),
                     rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` in page order below ``root``, with its index. One shuffle, paid once."""
    spark, root = df.sparkSession, root.rstrip("/")
    by = [F.col(c).asc_nulls_first() for c in (key, *tiebreak)]
    (df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", rows_per_file)
     .parquet(f"{root}/rows"))
    written = spark.read.schema(df.schema).parquet(f"{root}/rows")
    sizes = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # files are numbered by range partition, and by roll-over inside one
    number = [F.regexp_extract("file", p, 1).cast("long") for p in (r"part-(\d+)", r"-c(\d+)\.")]
    before = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)  # one line a file
    index = sizes.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_row"), "rows")
    index.coalesce(1).write.parquet(f"{root}/index")


def indexed_page(spark: SparkSession, root: str, schema, page: int = 1, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
    """Rows of 1-based ``page`` of the listing at ``root``, in order; empty beyond the end."""
    _check(page, per_page)
    root, begin, end = root.rstrip("/"), (page - 1) * per_page, page * per_page
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{root}/index")
    held = index.where((F.col("first_row") < end) & (F.col("first_row") + F.col("rows") > begin)).orderBy("first_row").collect()
    empty = spark.createDataFrame([], schema)
    if not held:
        return empty
    number = None
    for line in held:  # at most the files that one page touches
        own = F.when(F.col("_file") == line["file"], F.col("_row") + line["first_row"])
        number = own if number is None else F.coalesce(number, own)
    rows = spark.read.schema(empty.schema).parquet(*[f"{root}/rows/{line['file']}" for line in held])
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")).withColumn(
        "_number", number)
    return placed.where((F.col("_number") >= begin) & (F.col("_number") < end)).orderBy("_number").drop("_file", "_row", "_number")
