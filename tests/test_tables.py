"""Commit log, two writers, late snapshots, splitting buckets, compaction."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from orderpulse.session import create_file, list_dirs, path_exists, read_file
from orderpulse.sinks import tables
from orderpulse.sinks.tables import AppendTable, CommitLog, KeyedTable, VersionedTable
from orderpulse.streaming.loaders import apply_snapshots

KV = "k long, v long"


def rows(spark, pairs, schema=KV):
    return spark.createDataFrame(pairs, schema)


def content(df):
    return {r[0]: r[1] for r in df.collect()}


def newest(current, updates):
    both = current.withColumn("n", F.lit(0)).unionByName(updates.withColumn("n", F.lit(1)))
    return both.groupBy("k").agg(F.max_by("v", "n").alias("v"))


def envelope(epoch, *pairs):
    return json.dumps({"timestamp": epoch, "data": [{"Category": c, "count": n} for c, n in pairs]})


# commit log -------------------------------------------------------------------

def test_a_file_is_created_once_and_whole(spark, scratch):
    path = scratch("create") + "/x"
    made = []
    threads = [threading.Thread(target=lambda i=i: made.append((create_file(spark, path, f"text {i}"), i))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for ok, i in made if ok]
    assert len(winners) == 1 and read_file(spark, path) == f"text {winners[0]}"
    assert read_file(spark, path + "none") is None


def test_a_number_that_was_cleared_away_is_not_taken_again(spark, scratch):
    log = CommitLog(spark, scratch("log"))
    for n in range(tables.LOG_ENTRIES + 5):
        assert log.add(n, {"version": n})
    assert len(log.numbers()) == tables.LOG_ENTRIES and log.head() == (tables.LOG_ENTRIES + 4, {"version": tables.LOG_ENTRIES + 4})
    assert not log.add(2, {"version": 99}) and 2 not in log.numbers()   # a writer that slept
    assert not log.add(tables.LOG_ENTRIES, {"version": 99})


def test_two_writers_lose_no_commit(spark, scratch):
    root = scratch("two")
    one, two = VersionedTable(spark, root), VersionedTable(spark, root)
    first, second = one._claim(), two._claim()
    assert first != second                                  # never one folder
    for table, v in ((one, first), (two, second)):
        rows(spark, [(v, v)]).write.parquet(f"{table.versions}/version={v}")
    number = one.log.head()[0]
    assert two.commit(second, "two")
    assert not one.log.add(number + 1, {"version": first})  # the number that one had in mind is gone
    assert one.commit(first, "one")
    tags = one.log.head()[1]["tags"]
    assert tags == {"two": second, "one": first} and content(two.read()) == {first: first}


def test_a_keyed_merge_starts_again_after_another_commit(spark, scratch):
    root = scratch("merge-race")
    schema = rows(spark, [(0, 0)]).schema
    one, two = (KeyedTable(spark, root, schema, "k", buckets=2) for _ in range(2))
    one.merge(rows(spark, [(1, 1), (2, 2), (3, 3)]), newest, "a")
    calls = []

    def slow(current, updates):
        if not calls:                                       # the other writer is faster
            calls.append(two.merge(rows(spark, [(1, 100), (4, 4)]), newest, "b"))
        calls.append("merge")
        return newest(current, updates)

    one.merge(rows(spark, [(2, 200), (5, 5)]), slow, "c")
    assert calls.count("merge") == 2 and content(two.read()) == {1: 100, 2: 200, 3: 3, 4: 4, 5: 5}


# snapshots --------------------------------------------------------------------

def load(spark, table, *messages):
    return apply_snapshots(spark.createDataFrame([(m,) for m in messages], "value string").coalesce(1), table)


def test_a_late_snapshot_never_replaces_a_newer_one(spark, scratch):
    table = VersionedTable(spark, scratch("late"))
    load(spark, table, envelope(2000, ("a", 20)))
    assert load(spark, table, envelope(1000, ("a", 10))) is None
    assert {r.category: r["count"] for r in table.read().collect()} == {"a": 20}
    again = VersionedTable(spark, table.root)               # a restarted loader
    assert load(spark, again, envelope(1500, ("b", 1))) is None
    assert load(spark, again, envelope(2000, ("a", 20))) is None    # the same once more
    load(spark, again, envelope(3000, ("c", 3)), envelope(2500, ("d", 4)))
    assert {r.category: r["count"] for r in again.read().collect()} == {"c": 3}
    assert not list_dirs(spark, table.staging)


def test_the_older_of_two_loaders_is_refused_at_commit(spark, scratch):
    table = VersionedTable(spark, scratch("older"))
    frame = rows(spark, [(1, 1)])
    late = table._claim()
    frame.write.parquet(f"{table.versions}/version={late}")
    assert table.write_version(rows(spark, [(2, 2)]), "new", "2000") is not None
    assert not table.commit(late, "old", "1000")
    assert table.write_version(frame, "old", "1000") is None and content(table.read()) == {2: 2}


def test_an_unfinished_writers_folder_is_left_alone(spark, scratch):
    table = VersionedTable(spark, scratch("unfinished"), keep=1)
    slow = table._claim()
    rows(spark, [(7, 7)]).write.parquet(f"{table.versions}/version={slow}")
    for v in range(6):
        table.write_version(rows(spark, [(v, v)]), v)
    assert path_exists(spark, f"{table.versions}/version={slow}")
    assert table.commit(slow, "slow") and content(table.read()) == {7: 7}


# keyed tables -----------------------------------------------------------------

def test_buckets_split_and_an_update_stays_bounded(spark, scratch):
    schema = rows(spark, [(0, 0)]).schema
    table = KeyedTable(spark, scratch("split"), schema, "k", buckets=1, max_rows=50)
    want, sizes = {}, []
    for size in (20, 200, 2000):                             # 100 times as many keys
        more = {len(want) + i: i for i in range(size)}
        want |= more
        table.merge(rows(spark, list(more.items())), newest, f"load {size}")
        table.merge(rows(spark, [(3, -size)]), newest, f"update {size}")
        want[3] = -size
        head = table.log.head()[1]
        sizes.append(table.spark.read.parquet(f"{table.versions}/version={head['version']}").count())
        directory = head["buckets"]
        assert sum(n for _, _, n, _ in directory) == len(want) and max(n for _, _, n, _ in directory) <= 60
        # every key hash belongs to exactly one bucket
        assert sum(2.0 ** -b for b, *_ in directory) == 1.0
    assert content(table.read()) == want and max(sizes) <= 60
    assert len({b for b, *_ in directory}) > 1               # buckets of several depths


def test_keyed_table_of_several_keys_and_nulls(spark, scratch):
    schema = spark.createDataFrame([("a", None, 1)], "a string, b date, n long").schema
    table = KeyedTable(spark, scratch("keys"), schema, ["a", "b"], buckets=4)

    def add(current, updates):
        return current.unionByName(updates).groupBy("a", "b").agg(F.sum("n").alias("n"))

    for _ in range(2):
        table.merge(spark.createDataFrame([("a", None, 1), (None, None, 5)], schema), add, "once")
    table.merge(spark.createDataFrame([("a", None, 1)], schema), add, "more")
    assert {(r.a, r.n) for r in table.read().collect()} == {("a", 2), (None, 5)}


# append tables ----------------------------------------------------------------

def test_compaction_bounds_the_folders_and_replays_add_nothing(spark, scratch, monkeypatch):
    monkeypatch.setattr(AppendTable, "FAN_IN", 3)
    monkeypatch.setattr(AppendTable, "GRACE", 2)
    table = AppendTable(spark, scratch("append"))
    for b in range(30):
        assert table.append(rows(spark, [(b, b * b)]).coalesce(1), b, "run")
        assert not table.append(rows(spark, [(b, -1)]).coalesce(1), b, "run")
        folders = table.log.head()[1]["folders"]
        assert len(folders) <= 2 * 4                         # fewer than FAN_IN of each level
    schema = rows(spark, [(0, 0)]).schema
    assert content(table.read(schema)) == {b: b * b for b in range(30)}
    assert {r.batch_id for r in table.read(schema).collect()} == set(range(30))
    assert len(list_dirs(spark, table.root)) <= 30           # replaced folders go after GRACE commits
    assert sum(n.startswith("folder=") for n, _ in list_dirs(spark, table.root)) < 20


def test_a_reader_during_a_compaction_sees_each_row_once(spark, scratch, monkeypatch):
    monkeypatch.setattr(AppendTable, "FAN_IN", 4)
    table = AppendTable(spark, scratch("append-read"))
    schema = rows(spark, [(0, 0)]).schema
    for b in range(3):
        table.append(rows(spark, [(b, b)]).coalesce(1), b)
    before = table.read(schema)
    seen = []
    real = AppendTable._write

    def watched(self, frame):
        folder = real(self, frame)
        seen.append(sorted(r.k for r in AppendTable(spark, table.root).read(schema).collect()))
        return folder

    monkeypatch.setattr(AppendTable, "_write", watched)
    table.append(rows(spark, [(3, 3)]).coalesce(1), 3)       # the fourth: a compaction follows
    assert seen == [[0, 1, 2], [0, 1, 2, 3]]                 # before the commit of the batch, and of the compaction
    assert sorted(r.k for r in before.collect()) == [0, 1, 2]    # an old plan still finds its folders
    assert sorted(r.k for r in table.read(schema).collect()) == [0, 1, 2, 3]
    assert [lv for lv, _ in table.log.head()[1]["folders"]] == [1]


# dashboard --------------------------------------------------------------------

def test_dashboard_batches_add_their_changes_once(spark, scratch):
    from orderpulse.streaming import dashboard as D

    schema = "status string, grand_total decimal(18,4), Working_Date date, Category string"
    import datetime as dt
    from decimal import Decimal

    def items(*r):
        return spark.createDataFrame([(s, None if g is None else Decimal(g), dt.date(2024, 1, d) if d else None, c) for s, g, d, c in r], schema)

    table = VersionedTable(spark, scratch("dash"))
    measures = D.measures_table(table)
    one = items(("complete", "10.5", 1, "A"), ("canceled", None, 1, "B"), ("complete", "2", None, None))
    two = items(("complete", "1", 2, "A"))
    assert D.refresh(one, table, measures, "q 0") > 0
    assert D.refresh(one, table, measures, "q 0") is None    # a replay
    D.refresh(two, table, measures, "q 1")
    assert D.read_kpis(table).first().asDict() == {
        "total_orders": 4, "total_sales": 13.5, "avg_order_value": 4.5, "avg_order_value_page": 3.375, "complete_rate": 75.0}
    assert [(r.rank, r.Category, r.total) for r in D.read_top_categories(table).collect()] == [(1, "A", 11.5), (2, "B", 0.0)]
    # a batch of one day and category changes one row of each grain
    assert D.dashboard_deltas(two).count() == 4 and measures.read().count() == 1 + 3 + 3 + 4
    whole = one.unionByName(two)
    assert sorted(map(str, measures.read().collect())) == sorted(map(str, D.dashboard_deltas(whole).select(measures.schema.names).collect()))
    empty = items()
    D.refresh(empty, VersionedTable(spark, scratch("dash-empty")), D.measures_table(VersionedTable(spark, scratch("m"))), "q 0")


# relational -------------------------------------------------------------------

def test_jdbc_append_is_one_transaction_over_a_staging_table(spark, monkeypatch):
    saved, run = [], []

    class Writer:
        def mode(self, mode):
            saved.append(mode)
            return self

        def save(self):
            saved.append("saved")

    def fake(frame, url, table, properties):
        saved.append((table, frame.columns, frame.first().batch_id))
        return Writer()

    monkeypatch.setattr(tables, "_jdbc", fake)
    for _ in range(2):                                       # a retry stages and swaps the same batch again
        tables.append_jdbc(rows(spark, [(1, 2)]), "jdbc:none:", "t", 7, "it's", execute=run.append)
    stage = saved[0][0]
    assert stage.startswith("t_stage_") and saved[:3] == [(stage, ["k", "v", "run", "batch_id"], 7), "overwrite", "saved"]
    assert run[:2] == [["DELETE FROM t WHERE run = 'it''s' AND batch_id = 7",
                        f"INSERT INTO t (k, v, run, batch_id) SELECT k, v, run, batch_id FROM {stage}"], [f"DROP TABLE {stage}"]]
    assert run[:2] == run[2:]


def test_jdbc_append_stops_when_the_transaction_fails(spark, monkeypatch):
    class Writer:
        mode = lambda self, mode: self
        save = lambda self: None

    monkeypatch.setattr(tables, "_jdbc", lambda *a: Writer())

    def fail(statements):
        raise RuntimeError("no connection")

    with pytest.raises(RuntimeError):
        tables.append_jdbc(rows(spark, [(1, 2)]), "jdbc:none:", "t", 7, execute=fail)
