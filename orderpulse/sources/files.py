"""CSV readers for the order-item table and the publisher inputs.

* SRC-01 ``read_named_csv``: header row gives names; only the named fields
  are kept; a short row yields null for the missing fields.
* SRC-02 ``read_positional_csv``: no header handling by the reader; the
  header row is dropped by value (its field equals the column's name).
* SRC-03 ``read_typed_csv``: the 19-column table with an explicit schema
  (no ``inferSchema`` pass over the data).
* SRC-04 ``read_raw_csv``: every field as a string, header split off.

All are distributed scans: the files are split across tasks, nothing is
read on the driver. Fields are quoted as in RFC 4180: a quote inside a
quoted field is doubled. ``multi_line`` lets quoted fields hold line breaks;
such a file cannot be split, so one task reads each file whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpulse.schemas import ORDER_ITEM


def _reader(spark: SparkSession, header: bool, multi_line: bool):
    return (spark.read.option("header", header).option("encoding", "UTF-8").option("quote", '"')
            .option("escape", '"').option("multiLine", multi_line))


def read_named_csv(spark: SparkSession, path: str, fields: list[str],
                   mode: str = "PERMISSIVE", multi_line: bool = False) -> DataFrame:
    """Named fields of a headed CSV, as strings."""
    df = _reader(spark, True, multi_line).option("mode", mode).csv(path)
    missing = [f for f in fields if f not in df.columns]
    cols = [F.col(f"`{f}`") for f in fields if f in df.columns]
    cols += [F.lit(None).cast("string").alias(f) for f in missing]
    return df.select(*cols)


def read_positional_csv(spark: SparkSession, path: str, index: int,
                        header_value: str | None = None, name: str = "value",
                        multi_line: bool = False) -> DataFrame:
    """Column ``index`` (0-based) of a CSV read without a header; rows whose
    value equals ``header_value`` (the header row, wherever it occurs) are
    dropped, and so are rows too short to have the column (or with it
    empty), which would otherwise become empty messages. The width does not
    depend on the first line."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(index + 1)])
    df = _reader(spark, False, multi_line).schema(schema).csv(path)
    out = df.select(F.col(f"_c{index}").alias(name)).where(F.col(name).isNotNull())
    if header_value is not None:
        out = out.where(F.col(name) != F.lit(header_value))
    return out


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType = ORDER_ITEM,
                   mode: str = "PERMISSIVE", multi_line: bool = False,
                   corrupt: str | None = None) -> DataFrame:
    """The order-item table with an explicit schema. Give ``corrupt`` a
    column name to get the text of lines of the wrong width or with values
    of the wrong type there (null for good lines), so that they can be set
    aside; without it such lines keep what could be read."""
    reader = _reader(spark, True, multi_line).option("mode", mode)
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).csv(path)


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All fields as strings, header row used for names."""
    return _reader(spark, True, multi_line).csv(path)


def read_message_files(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of message files: one message per line, column ``value``."""
    return spark.read.text(path).select("value")
