"""Column helpers against plain Python semantics."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from orderpulse.functions import (
    category_or_default, epoch_to_utc, fixed2, is_present, json_path, money,
    percent1, py_strip, severity, utc_to_epoch,
)
from orderpulse.functions.text import PY_WHITESPACE_CHARS, PY_WHITESPACE_CLASS_RE2

WS = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_whitespace_set_is_python_isspace():
    assert sorted(PY_WHITESPACE_CHARS) == WS


def test_oracle_whitespace_class_matches_python():
    import duckdb

    probe = WS + ["a", "\u200b", "\ufeff", "_"]
    con = duckdb.connect()
    got = {c for c in probe
           if con.execute(f"SELECT regexp_full_match(?, '{PY_WHITESPACE_CLASS_RE2}')", [c]).fetchone()[0]}
    assert got == set(WS)


def test_py_strip_edge_cases(spark):
    rows = [("\u3000x\t ",), ("\x1c\x1dy\x1e\x1f",), ("  ",), ("",), (None,), ("a b",)]
    df = spark.createDataFrame(rows, "c string")
    got = [r.s for r in df.select(py_strip("c").alias("s")).collect()]
    assert got == ["x", "y", "", "", None, "a b"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(WS[:12] + ["a", "b", " ", "\u3000"]), max_size=6),
                min_size=1, max_size=8))
def test_py_strip_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r.s for r in df.select(py_strip("c").alias("s")).collect()]
    assert got == [t.strip() for t in texts]


def test_is_present_and_default(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "c string")
    assert [r.p for r in df.select(is_present("c").alias("p")).collect()] == [True, False, False]
    assert [r.d for r in df.select(category_or_default("c").alias("d")).collect()] == ["a", "N/A", "N/A"]


def test_severity(spark):
    df = spark.createDataFrame([("complete",), ("canceled",), ("order_refunded",),
                                ("processing",), (None,), ("Complete",)], "s string")
    got = [r.v for r in df.select(severity("s").alias("v")).collect()]
    assert got == ["success", "danger", "warning", None, None, None]


def test_json_path_missing_and_malformed(spark):
    df = spark.createDataFrame([('{"item_id": 2}',), ("bad",), ('{"item_id": 1, "Category": "x"}',)], "v string")
    got = [(r.i, r.c) for r in df.select(json_path("v", "$.item_id").alias("i"),
                                         json_path("v", "$.Category").alias("c")).collect()]
    assert got == [("2", None), (None, None), ("1", "x")]


def test_display_formats_match_python(spark):
    values = [0.0, 0.125, 2.675, 1234567.125, 1234.5, 99.995, 7.0, 12.3456, 1e9 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(fixed2("x").alias("a"), money("x").alias("b"), percent1("x").alias("c")).collect()
    for v, r in zip(values, got):
        assert r.a == "%.2f" % v
        assert r.b == "¥{:,.2f}".format(v)
        assert r.c == "{:.1f}%".format(v)


def test_epoch_round_trip_is_zone_independent(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        df = spark.createDataFrame([(1704067207,), (0,), (1,)], "e long")
        out = df.select(epoch_to_utc("e").alias("t")).select("t", utc_to_epoch("t").alias("back")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert out[0].t == dt.datetime(2024, 1, 1, 0, 0, 7)
    assert [r.back for r in out] == [1704067207, 0, 1]


def test_wellformed_json_reads_the_whole_text(spark):
    from orderpulse.functions.json import is_wellformed_json

    cases = {"123": True, '{"a": 1}': True, "[1, 2]": True, '  {"Category": "A"}  ': True,
             '"s"': True, "null": True, "8294 and then prose": False, '{"a": 1} trailing': False,
             "1,2": False, "": False, "bad": False, '{"a": 1': False}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.ok for r in df.select("v", is_wellformed_json("v").alias("ok")).collect()}
    assert got == cases
