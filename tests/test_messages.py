"""Message parsing, validation, snapshot shapes and routing."""

from pyspark.sql import functions as F

from orderpulse.operators import cleaning, snapshot


def msgs(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_classify_messages(spark):
    df = msgs(spark, ['{"item_id": 1, "Category": "A"}', "bad", '{"item_id": 2}',
                      '{"item_id": 4, "Category": ""}', '{"item_id": "x1", "Category": "B"}',
                      None, '{"item_id": 5, "Category": "\\u3000\\t "}'])
    got = [(r.reason, r.item_id, r.Category) for r in cleaning.classify_messages(df).collect()]
    assert got == [("ok", 1, "A"), ("malformed", None, None), ("missing_category", 2, None),
                   ("missing_category", 4, ""), ("bad_item_id", None, "B"),
                   ("tombstone", None, None), ("missing_category", 5, "")]


def test_running_count_filter(spark):
    from orderpulse.streaming.category_count import category_counts

    df = msgs(spark, ['{"item_id": 1, "Category": "A"}', '{"item_id": 2}', "bad",
                      '{"item_id": 3, "Category": ""}', '{"item_id": 4, "Category": "A"}',
                      '{"item_id": 5, "Category": "B"}'])
    assert {(r.Category, r["count"]) for r in category_counts(df).collect()} == {("A", 2), ("B", 1)}


def test_result_rows_round_trip(spark):
    counts = spark.createDataFrame([("A", 3), ("", 1), (None, 2), ("B", 0)], "Category string, count long")
    back = cleaning.result_counts(cleaning.result_rows(counts))
    assert [(r.Category, r["count"]) for r in back.collect()] == [("A", 3), ("B", 0)]
    text = spark.createDataFrame([("C", ""), ("D", None), ("E", "7")], "key string, value string")
    assert [(r.Category, r["count"]) for r in cleaning.result_counts(text).collect()] == [("E", 7)]


def test_strict_id_cast_fails_lenient_keeps_row(spark):
    import pytest
    from orderpulse.sinks.messages import item_messages

    df = spark.createDataFrame([("x1", "A")], "item_id string, Category string")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match="invalid item_id: x1"):
                item_messages(df, strict=True).collect()
        finally:
            spark.conf.set("spark.sql.ansi.enabled", "true")
    ok = spark.createDataFrame([("12", "A")], "item_id string, Category string")
    assert item_messages(ok, strict=True).first().value == '{"item_id":12,"Category":"A"}'
    assert item_messages(df, strict=False).first().value == '{"Category":"A"}'


def test_all_three_shapes_read(spark):
    counts = spark.createDataFrame([("A", 2), ("B", 1)], "Category string, count long")
    env = snapshot.envelope_messages(counts, 7, 1704067200)
    arr = snapshot.array_message(counts)
    obj = snapshot.object_messages(counts)
    tomb = spark.createDataFrame([(None,)], "value string")
    routed = snapshot.route_messages(env.unionByName(arr).unionByName(obj).unionByName(tomb))
    rows = snapshot.explode_entries(routed).collect()
    by_shape = {}
    for r in rows:
        by_shape.setdefault(r.shape, set()).add((r.Category, r["count"]))
    assert by_shape == {s: {("A", 2), ("B", 1)} for s in ("envelope", "array", "object")}
    routes = {(r.shape, r.route) for r in routed.collect()}
    assert routes == {("envelope", "load"), ("array", "raw"), ("object", "raw"), ("tombstone", "skip")}
    e = snapshot.envelope_rows(env).collect()
    assert {r.snapshot_id for r in e} == {7} and {str(r.timestamp) for r in e} == {"2024-01-01 00:00:00"}


def test_envelope_split_into_parts(spark):
    counts = spark.range(1000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("Category"),
                                      F.col("id").alias("count"))
    env = snapshot.envelope_messages(counts, 1, 0, 16)
    rows = snapshot.envelope_rows(env)
    assert rows.count() == 1000 and env.count() == 16
    sizes = [r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 120
    assert {r.parts for r in rows.select("parts").distinct().collect()} == {16}
    few = snapshot.envelope_messages(counts.limit(3), 1, 0, 16)     # parts without entries are sent
    assert few.count() == 16 and snapshot.envelope_rows(few).count() == 3


def test_strict_json(spark):
    from orderpulse.functions.json import is_wellformed_json

    good = ['{"a":1}', "[1,2]", "7", ' {"a": "]"} ', '"x"', "null", '{"a": "it\'s"}', "[]", "{}"]
    bad = ['{"Category":"a","count":1}] junk', "{'Category':'a','count':1}", "1],[2", "", " ", "1,2", "123 and more", "{"]
    df = msgs(spark, good + bad + [None])
    got = [r.ok for r in df.select(is_wellformed_json("value").alias("ok")).collect()]
    assert got == [True] * len(good) + [False] * (len(bad) + 1)


def test_latest_per_key(spark):
    rows = spark.createDataFrame([("A", 1, 10, 0), ("A", 5, 10, 1), ("A", 9, 5, 9), ("B", 2, 1, 0)],
                                 "k string, count long, ts long, seq long")
    got = {(r.k, r["count"]) for r in snapshot.latest_per_key(rows, "k", ["ts", "seq"], ["count"]).collect()}
    assert got == {("A", 5), ("B", 2)}
