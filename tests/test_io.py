"""Readers and writers on small files."""

import json

import pytest

from orderpulse.functions import bytes_to_string
from orderpulse.schemas import CATEGORY_STATS
from orderpulse.sinks.messages import print_messages, write_message_files
from orderpulse.sinks.tables import ensure_table
from orderpulse.sources.files import read_named_csv, read_positional_csv, read_raw_csv
from orderpulse.sources.topic import read_message_file_stream
from orderpulse.streaming.category_count import console_sink, start_category_count


def write_text(path, text):
    import os
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w", encoding="utf-8") as fh:
        fh.write(text)


def test_named_csv_short_row_and_extra_columns(spark, scratch):
    from orderpulse.session import local_path
    p = scratch("csv")
    write_text(local_path(p), "item_id,Category,extra\n1,A,x\n2\n3,,y\n")
    rows = [(r.item_id, r.Category, r.missing) for r in
            read_named_csv(spark, p, ["item_id", "Category", "missing"]).collect()]
    assert rows == [("1", "A", None), ("2", None, None), ("3", None, None)]


def test_positional_csv_drops_header_value_anywhere(spark, scratch):
    from orderpulse.session import local_path
    p = scratch("pos")
    lines = ["a,b,c,d,e,f,g,h,i,gender", "1,2,3,4,5,6,7,8,9,F", "1,2,3,4,5,6,7,8,9,gender",
             "1,2,3,4,5,6,7,8,9,M,extra", "1,2,3", "1,2,3,4,5,6,7,8,9,"]
    write_text(local_path(p), "\n".join(lines) + "\n")
    assert [r.value for r in read_positional_csv(spark, p, 9, "gender").collect()] == ["F", "M"]


def test_raw_csv_is_all_strings(spark, scratch):
    from orderpulse.session import local_path
    p = scratch("raw")
    write_text(local_path(p), "item_id,price\n1,2.50\n")
    df = read_raw_csv(spark, p)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string"]
    assert df.first().price == "2.50"


def test_bytes_to_string(spark):
    df = spark.createDataFrame([(bytearray('{"Category": "A"}'.encode()),)], "value binary")
    assert df.select(bytes_to_string("value").alias("s")).first().s == '{"Category": "A"}'


def test_print_and_console_sink(spark, capsys):
    df = spark.createDataFrame([("hello",)], "value string")
    print_messages(df)
    console_sink()(spark.range(3000).selectExpr("cast(id as string) as Category", "id as count"), 3)
    out = capsys.readouterr().out
    assert "hello" in out and "-- batch 3" in out and "\n2999\t2999" in out   # every row


def test_quoted_fields(spark, scratch):
    from orderpulse.session import local_path
    p = scratch("quoted")
    write_text(local_path(p), 'item_id,Category,extra\n1,"he said ""x"", ok",2\n2,"two\nlines",3\n')
    rows = read_named_csv(spark, p, ["item_id", "Category", "extra"], multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", 'he said "x", ok', "2"), ("2", "two\nlines", "3")]


def test_lines_of_the_wrong_width_are_set_aside(spark, scratch):
    from pyspark.sql import types as T

    from orderpulse.session import local_path
    from orderpulse.sources.files import read_typed_csv
    p = scratch("width")
    write_text(local_path(p), "a,b\n1,2\n3\n4,x\n5,6,7\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    rows = read_typed_csv(spark, p, schema, corrupt="bad").collect()
    assert [(r.a, r.b, r.bad) for r in rows] == [(1, 2, None), (3, None, "3"), (4, None, "4,x"), (5, 6, "5,6,7")]


def test_positional_csv_with_a_short_first_line(spark, scratch):
    from orderpulse.session import local_path
    p = scratch("ragged")
    write_text(local_path(p), "a,b\n1,2,3,4,5,6,7,8,9,F\n1,2,3,4,5,6,7,8,9,M,x\n")
    assert [r.value for r in read_positional_csv(spark, p, 9).collect()] == ["F", "M"]


def test_ensure_table_creates_schema_once(spark, scratch):
    p = scratch("ensure")
    ensure_table(spark, p, CATEGORY_STATS)
    ensure_table(spark, p, CATEGORY_STATS)
    df = spark.read.parquet(p)
    assert df.columns == ["category", "count", "timestamp", "updated_at"] and df.count() == 0


def test_processing_time_trigger(spark, scratch):
    from orderpulse.sinks.tables import VersionedTable
    from orderpulse.streaming.category_count import snapshot_table_sink

    base = scratch("ptime")
    write_message_files(spark.createDataFrame([(json.dumps({"item_id": 1, "Category": "A"}),)],
                                              "value string").coalesce(1), f"{base}/in")
    table = VersionedTable(spark, f"{base}/t")
    q = start_category_count(read_message_file_stream(spark, f"{base}/in"), f"{base}/ckpt",
                             [snapshot_table_sink(table)], trigger="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.category, r["count"]) for r in table.read().collect()] == [("A", 1)]


def test_jdbc_reader_argument_checks(spark):
    import pytest

    from orderpulse.sources.jdbc import read_jdbc

    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none://x")                       # neither table nor query
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none://x", table="t", query="select 1")
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none://x", query="select 1", partition_column="id",
                  lower_bound=0, upper_bound=10)
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none://x", table="t", partition_column="id")     # no bounds


def test_update_mode_is_validated(spark, scratch):
    import pytest

    from orderpulse.streaming.category_count import start_category_count

    import os

    from orderpulse.session import local_path

    src = scratch("nothing")
    os.makedirs(local_path(src))
    stream = read_message_file_stream(spark, src)
    with pytest.raises(ValueError):
        start_category_count(stream, scratch("ck"), [], output_mode="append")


def test_topic_source_needs_the_connector(spark):
    """No broker connector is installed here: the topic source must fail
    loudly (never fall back silently); with the connector it would load."""
    import pytest

    from orderpulse.sources.topic import read_topic_stream

    with pytest.raises(Exception, match="(?i)kafka"):
        read_topic_stream(spark, "category", "localhost:9092")


@pytest.mark.parametrize("seed", range(4))
def test_equal_predicates_cover_each_row_once(spark, seed):
    import random

    import duckdb

    from orderpulse.sources.jdbc import equal_predicates, histogram_query

    rnd = random.Random(seed)
    values = [None] * rnd.choice([0, 50]) + [int(rnd.paretovariate(0.7)) - rnd.choice([0, 500]) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    low, high = con.sql("SELECT min(k), max(k) FROM t").fetchall()[0]
    histogram = [(int(a), b) for a, b in con.sql(histogram_query("t", "k", low, high, 4096)).fetchall()]
    assert sum(n for _, n in histogram) == sum(v is not None for v in values)
    parts = equal_predicates("k", histogram, 6)
    counts = [con.sql(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in parts]
    assert sum(counts) == len(values) and len(parts) <= 7
    assert con.sql("SELECT count(*) FROM t WHERE " + " + ".join(f"coalesce(CAST(({p}) AS INT), 0)" for p in parts) + " <> 1").fetchall()[0][0] == 0
    largest = max(n for _, n in histogram)
    assert max(counts[1:]) <= len(values) / 6 + largest
    # rows outside the counted span are read as well, and an empty table has two parts
    assert spark.range(-10 ** 7, 10 ** 7, 10 ** 6).toDF("k").where(" OR ".join(f"({p})" for p in parts)).count() == 20
    assert equal_predicates("k", [], 6) == ["k IS NULL", "k IS NOT NULL"]
    assert equal_predicates("k", [(5, 100)], 6) == ["k IS NULL", "k IS NOT NULL"]


def test_balanced_read_asks_the_database_for_its_bounds(spark, monkeypatch):
    from pyspark.sql import DataFrameReader

    from orderpulse.sources import jdbc

    asked = []

    def fake(spark_, url, table=None, query=None, properties=None, **_):
        asked.append(query)
        if "MIN(k)" in query:
            return spark.createDataFrame([(0, 99)], "low long, high long")
        return spark.createDataFrame([(0, 90), (50, 5), (60, 5)], "low long, n long")

    monkeypatch.setattr(jdbc, "read_jdbc", fake)
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda self, url, table, predicates, properties: (table, predicates))
    assert jdbc.read_jdbc_balanced(spark, "jdbc:none:", "t", "k", partitions=2, cells_per_partition=5) == (
        "t", ["k IS NULL", "k < 50", "k >= 50"])
    assert asked[1] == "SELECT 0 + 10 * FLOOR((k - 0) / 10) AS low, COUNT(*) AS n FROM t WHERE k IS NOT NULL GROUP BY FLOOR((k - 0) / 10)"
