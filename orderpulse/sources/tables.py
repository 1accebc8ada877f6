"""Parquet table reads with explicit column lists.

Selecting the needed columns right at the scan keeps ``ReadSchema`` narrow;
filters written downstream are pushed into the Parquet reader by Catalyst.

For the supplied tables the column types are known, so a read names its
columns with their types instead of inferring the schema from a file
footer. That saves a driver-side job per read, and the reader still
checks the requested types against the file. Columns not listed here fall
back to inference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()

# Column types of the supplied tables that the queries read
# (TIMESTAMP columns are stored without a zone, so they read as timestamp_ntz).
TABLE_TYPES: dict[str, dict[str, T.DataType]] = {
    "lineitem": {"l_orderkey": _L, "l_partkey": _L, "l_suppkey": _L, "l_linenumber": _I,
                 "l_quantity": _D, "l_extendedprice": _D, "l_discount": _D, "l_tax": _D,
                 "l_returnflag": _S, "l_linestatus": _S, "l_shipdate": _TS},
    "orders": {"o_orderkey": _L, "o_custkey": _L, "o_orderstatus": _S, "o_totalprice": _D,
               "o_orderdate": _TS, "o_orderpriority": _S},
    "part": {"p_partkey": _L, "p_name": _S, "p_brand": _S, "p_type": _S, "p_size": _I,
             "p_retailprice": _D},
    "customer": {"c_custkey": _L, "c_name": _S, "c_nationkey": _I, "c_acctbal": _D,
                 "c_mktsegment": _S},
    "events": {"event_id": _L, "ts": _TS, "user_id": _L, "event_type": _S, "value": _D,
               "props": _S},
    "documents": {"text": _S},
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    path = table_path(sf_dir, name)
    types = TABLE_TYPES.get(name, {})
    if columns and all(c in types for c in columns):
        schema = T.StructType([T.StructField(c, types[c]) for c in columns])
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
