"""Paging: every path agrees with a brute-force slice of the sorted keys."""

import pytest
from pyspark.sql import functions as F

from orderpulse.operators import paging


@pytest.fixture(scope="module")
def table(spark):
    # 2,000 unique keys, unevenly spaced, in shuffled order across partitions
    keys = [i * 7 + (i % 5) for i in range(2000)]
    df = spark.createDataFrame([(k, f"r{k}") for k in reversed(keys)], "k long, v string")
    return df.repartition(5), sorted(keys)


@pytest.mark.parametrize("page,per_page", [(1, 25), (3, 25), (40, 50), (80, 25), (81, 25), (999, 25), (7, 13)])
def test_shallow_and_deep_agree_with_slice(table, page, per_page):
    df, keys = table
    want = keys[(page - 1) * per_page: page * per_page]
    shallow = [r.k for r in paging.page_rows(df, "k", page, per_page).collect()]
    deep = [r.k for r in paging.page_rows(df, "k", page, per_page, window=per_page, fanout=8).collect()]
    assert shallow == want
    assert deep == want


def test_keyset_page(table):
    df, keys = table
    got = [r.k for r in paging.page_after(df, "k", keys[99], 10).collect()]
    assert got == keys[100:110]
    assert [r.k for r in paging.page_after(df, "k", None, 3).collect()] == keys[:3]


def test_rejects_bad_page_numbers(table):
    df, _ = table
    with pytest.raises(ValueError):
        paging.page_rows(df, "k", 0, 25)
    with pytest.raises(ValueError):
        paging.page_rows(df, "k", 1, 0)
    with pytest.raises(ValueError):
        paging.page_metadata(df, 0, 25)


def test_metadata(spark, table):
    df, keys = table
    m = paging.page_metadata(df, 3, 25).first()
    assert (m.total, m.total_pages, m.start_page, m.end_page) == (2000, 80, 1, 5)
    m = paging.page_metadata(df, 999, 25).first()
    assert (m.total_pages, m.start_page, m.end_page) == (80, 997, 80)
    empty = spark.createDataFrame([], "k long")
    m = paging.page_metadata(empty, 1, 25).first()
    assert (m.total, m.total_pages, m.start_page, m.end_page) == (0, 0, 1, 0)


def test_deep_page_plan_has_no_single_partition_window(table):
    df, _ = table
    out = paging.page_rows(df, "k", 60, 25, window=25, fanout=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert out.where(F.col("k").isNull()).count() == 0


def test_non_unique_key_with_tiebreak_matches_slice(spark):
    # 1,500 rows over 40 key values; one value holds a third of the rows
    rows = [(0 if i % 3 == 0 else 1 + i % 39, i * 7919 % 1000, f"s{i % 13}") for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, a long, s string").repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    for page in (1, 7, 21, 40, 60, 61):
        want = ordered[(page - 1) * 25: page * 25]
        got = [tuple(r) for r in paging.page_rows(df, "k", page, 25, window=50, fanout=4,
                                                  tiebreak=["a", "s"]).collect()]
        assert got == want, page


@pytest.mark.parametrize("kind", ["long", "string", "double", "date", "decimal(12,2)"])
def test_every_page_is_the_same_by_both_ways(spark, kind):
    # a third of the keys null, one value in a third of the rows, the rest unique
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, i * 7919 % 1009) for i in range(600)]
    df = spark.createDataFrame(rows, "n long, t long").repartition(4)
    key = F.date_add(F.lit("2020-01-01").cast("date"), F.col("n").cast("int")) if kind == "date" else F.col("n").cast(kind)
    df = df.select(key.alias("k"), "t")
    seen = []
    for page in (1, 2, 3, 7, 8, 9, 13, 15, 16, 17, 20, 24, 25):
        plain = [tuple(r) for r in paging.page_rows(df, "k", page, 25, tiebreak=["t"]).collect()]
        narrowed = [tuple(r) for r in paging.page_rows(df, "k", page, 25, window=25, fanout=4, tiebreak=["t"]).collect()]
        assert narrowed == plain
        seen += plain
    assert len(seen) == 12 * 25 and len(set(seen)) == len(seen)


def test_bounds_reach_the_scan(spark):
    from orderpulse.plans import listing

    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for query, column in ((listing.order_page_deep, "o_orderkey"), (listing.item_page, "l_orderkey")):
        text = query(spark, "/root/testdata/sf0.01")._jdf.queryExecution().explainString(mode)
        assert f"GreaterThanOrEqual({column}," in text and "cast(" not in text.split("PushedFilters")[1].split("ReadSchema")[0]


def test_indexed_pages_equal_page_rows(spark, scratch):
    import random

    from orderpulse.operators import page_index, paging

    rnd = random.Random(3)
    rows = [(rnd.choice([None, "", "a", "b", "zz"]), rnd.choice([None, 1, 2, 3]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    root = scratch("page-index")
    page_index.write_page_index(df, root, "k", ["t", "id"], rows_per_file=90)
    index = spark.read.parquet(f"{root}/index").orderBy("first_row").collect()
    assert len(index) >= 8 and [r["first_row"] for r in index] == [sum(x["rows"] for x in index[:i]) for i in range(len(index))]
    for page, size in ((1, 25), (4, 25), (1, 700), (3, 300), (28, 25), (29, 25), (10 ** 9, 25)):
        want = paging.page_rows(df, "k", page, size, tiebreak=["t", "id"]).collect()
        assert page_index.indexed_page(spark, root, df.schema, page, size).collect() == want
    with pytest.raises(ValueError):
        page_index.indexed_page(spark, root, df.schema, 0)
    empty = scratch("page-index-empty")
    page_index.write_page_index(df.limit(0), empty, "k", ["t", "id"])
    assert page_index.indexed_page(spark, empty, df.schema, 1).count() == 0
