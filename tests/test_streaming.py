"""Streaming job and loaders: multi-batch equals batch, restart continues,
replays are idempotent, snapshots swap atomically."""

import json

from orderpulse.functions.time import utc_to_epoch

from orderpulse.sinks.messages import write_message_batch, write_message_files
from orderpulse.schemas import CATEGORY_STATS
from orderpulse.sinks.tables import KeyedTable, VersionedTable, append_batch
from orderpulse.sources.topic import read_message_file_stream
from orderpulse.streaming.category_count import (
    category_counts, snapshot_message_sink, snapshot_table_sink, start_category_count,
)
from orderpulse.streaming.loaders import (
    apply_snapshots, start_append_loader, start_snapshot_loader, start_upsert_loader,
)


def write_lines(spark, path, lines):
    write_message_files(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), path)


def item(i, c):
    return json.dumps({"item_id": i, "Category": c})


def run_counts(spark, src, ckpt, table, extra_sinks=(), state_partitions=None):
    from orderpulse.streaming.category_count import streaming_session

    job = streaming_session(spark, state_partitions)
    stream = read_message_file_stream(job, src, max_files_per_trigger=1)
    q = start_category_count(stream, ckpt, [snapshot_table_sink(table), *extra_sinks], available_now=True)
    q.awaitTermination()
    return q


def keyed_table(spark, root, **options):
    return KeyedTable(spark, root, CATEGORY_STATS, "category", **options)


def as_dict(df, k="category", v="count"):
    return {r[k]: r[v] for r in df.collect()}


def test_multi_batch_stream_equals_batch_and_restart_continues(spark, scratch):
    base = scratch("stream")
    src = f"{base}/in"
    for b in range(3):
        write_lines(spark, src, [item(b * 10, "A"), item(b * 10 + 1, "B"), item(b * 10 + 2, "A"),
                                 item(b * 10 + 3, ""), "bad", json.dumps({"item_id": 5})])
    table = VersionedTable(spark, f"{base}/table")
    q = run_counts(spark, src, f"{base}/ckpt", table, state_partitions=2)
    assert q.lastProgress["stateOperators"][0]["numShufflePartitions"] == 2
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"  # caller's session untouched
    want = as_dict(category_counts(spark.read.text(src)), "Category")
    assert as_dict(table.read()) == want == {"A": 6, "B": 3}
    # restart with the same checkpoint after one more file: counts continue
    write_lines(spark, src, [item(99, "C"), item(98, "A")])
    run_counts(spark, src, f"{base}/ckpt", table)
    assert as_dict(table.read()) == {"A": 7, "B": 3, "C": 1}


def test_snapshot_messages_and_loader(spark, scratch):
    base = scratch("snap")
    src = f"{base}/in"
    for b in range(2):
        write_lines(spark, src, [item(b, "A"), item(b + 10, "B")])
    table = VersionedTable(spark, f"{base}/table")
    sink = snapshot_message_sink(lambda m, batch: write_message_batch(m, f"{base}/results", batch),
                                 clock=lambda: 1700000000)
    run_counts(spark, src, f"{base}/ckpt", table, [sink])
    msgs = [json.loads(r.value) for r in spark.read.text(f"{base}/results").collect()]
    assert len(msgs) == 2 and all(m["timestamp"] == 1700000000 for m in msgs)
    latest = max(msgs, key=lambda m: m["snapshot_id"])
    assert sorted((d["Category"], d["count"]) for d in latest["data"]) == [("A", 2), ("B", 2)]

    reloaded = VersionedTable(spark, f"{base}/reloaded")
    stream = read_message_file_stream(spark, f"{base}/results", max_files_per_trigger=1)
    q = start_snapshot_loader(stream, reloaded, f"{base}/loader-ckpt", raw_root=f"{base}/raw",
                              available_now=True)
    q.awaitTermination()
    assert as_dict(reloaded.read()) == {"A": 2, "B": 2}


def test_shrinking_snapshot_and_replay(spark, scratch):
    base = scratch("shrink")
    table = VersionedTable(spark, f"{base}/t")

    def env(sid, data, part=0, parts=1):
        return json.dumps({"timestamp": sid, "snapshot_id": sid, "part": part, "parts": parts,
                           "data": [{"Category": c, "count": n} for c, n in data]})

    b1 = spark.createDataFrame([(env(1, [("A", 1), ("B", 1)]),)], "value string")
    assert apply_snapshots(b1, table) == 0
    assert as_dict(table.read()) == {"A": 1, "B": 1}
    b2 = spark.createDataFrame([(env(2, [("A", 5), ("", 3), (None, 1), ("Z", None)]),), (None,), ("bad",)],
                               "value string")
    apply_snapshots(b2, table)
    assert as_dict(table.read()) == {"A": 5}          # B is gone after the reload
    apply_snapshots(b2, table)                         # replayed batch
    assert as_dict(table.read()) == {"A": 5}
    # a two-part snapshot is only visible once both parts are in
    apply_snapshots(spark.createDataFrame([(env(3, [("X", 1)], 0, 2),)], "value string"), table)
    assert as_dict(table.read()) == {"A": 5}
    apply_snapshots(spark.createDataFrame([(env(3, [("Y", 2)], 1, 2),)], "value string"), table)
    assert as_dict(table.read()) == {"X": 1, "Y": 2}


def test_append_is_idempotent_per_batch(spark, scratch):
    root = scratch("append")
    rows = spark.createDataFrame([("A", 1)], "Category string, count long")
    append_batch(rows, root, 0)
    append_batch(rows, root, 0)
    append_batch(rows, root, 1)
    append_batch(rows, root, 0, "another run")   # a fresh checkpoint counts from 0 again
    df = spark.read.parquet(root)
    assert df.count() == 3 and {r.batch_id for r in df.collect()} == {0, 1}


def test_append_loader_quarantines(spark, scratch):
    base = scratch("append-loader")
    write_lines(spark, f"{base}/in", [json.dumps({"Category": "A", "count": 3}), "bad",
                                      json.dumps({"Category": "", "count": 1}), "7",
                                      json.dumps([{"Category": "B", "count": 1}]), '{"Category":"a","count":1}] junk',
                                      json.dumps({"timestamp": 1, "data": [{"Category": "C", "count": 2}]}),
                                      json.dumps({"timestamp": 1, "data": []}), "{'Category':'a','count':1}"])
    stream = read_message_file_stream(spark, f"{base}/in")
    q = start_append_loader(stream, f"{base}/t", f"{base}/q", f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    assert sorted((r.Category, r["count"]) for r in spark.read.parquet(f"{base}/t").collect()) == [
        ("A", 3), ("B", 1), ("C", 2)]
    reasons = sorted(r.reason for r in spark.read.parquet(f"{base}/q").collect())
    assert reasons == ["invalid_entry", "malformed", "malformed", "malformed", "other"]


def test_upsert_last_write_wins(spark, scratch):
    base = scratch("upsert")

    def env(ts, c, n):
        return json.dumps({"timestamp": ts, "snapshot_id": 0, "part": 0, "parts": 1,
                           "data": [{"Category": c, "count": n}]})

    write_lines(spark, f"{base}/in", [env(10, "A", 10), env(10, "A", 4), env(15, "B", 7)])
    table = keyed_table(spark, f"{base}/t")
    q = start_upsert_loader(read_message_file_stream(spark, f"{base}/in"), table, f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    assert as_dict(table.read()) == {"A": 4, "B": 7}   # the later, smaller count of the same second
    write_lines(spark, f"{base}/in", [env(5, "A", 99), env(30, "B", 8)])
    stream = read_message_file_stream(spark, f"{base}/in", max_files_per_trigger=1)
    q = start_upsert_loader(stream, table, f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    got = {r.category: (r["count"], r.e) for r in
           table.read().select("category", "count", utc_to_epoch("timestamp").alias("e")).collect()}
    assert got == {"A": (99, 5), "B": (8, 30)}


def test_versioned_table_keeps_recent_versions(spark, scratch):
    from orderpulse.session import list_dirs, list_files

    root = scratch("vacuum")
    table = VersionedTable(spark, root, keep=2)
    for v in range(40):
        table.write_version(spark.createDataFrame([("A", v)], "category string, count long"), v)
    assert as_dict(table.read()) == {"A": 39}
    versions = sorted(int(n.split("=")[1]) for n, _ in list_dirs(spark, table.versions))
    assert versions[-2:] == [38, 39] and len(versions) < 4  # pruned once 2*keep folders exist
    assert len([n for n, _ in list_files(spark, table.pointer) if n.endswith(".parquet")]) <= 33


def test_read_appended_before_any_rows(spark, scratch):
    from orderpulse.schemas import CATEGORY_COUNT
    from orderpulse.sinks.tables import read_appended

    root = scratch("empty-append")
    assert read_appended(spark, root, CATEGORY_COUNT).count() == 0
    append_batch(spark.createDataFrame([], CATEGORY_COUNT), root, 0)
    df = read_appended(spark, root, CATEGORY_COUNT)
    assert df.count() == 0 and df.columns == ["Category", "count", "batch_id"]


def test_version_numbers_outlive_a_fresh_checkpoint(spark, scratch):
    table = VersionedTable(spark, scratch("fresh"))
    for batch in range(8):
        table.write_version(spark.createDataFrame([("A", batch)], "category string, count long"), f"one {batch}")
    for batch in range(2):
        table.write_version(spark.createDataFrame([("B", batch)], "category string, count long"), f"two {batch}")
        assert as_dict(table.read()) == {"B": batch}
    assert table.write_version(spark.createDataFrame([("C", 9)], "category string, count long"), "two 1") == 9
    assert as_dict(VersionedTable(spark, table.root).read()) == {"B": 1}    # the replay wrote nothing


def test_empty_version_is_read_and_updated(spark, scratch):
    base = scratch("empty-version")
    table = VersionedTable(spark, f"{base}/t")
    table.write_version(spark.createDataFrame([], "category string, count long"))
    assert table.read().count() == 0
    write_lines(spark, f"{base}/in", ["junk"])
    keyed = keyed_table(spark, f"{base}/k")

    def run():
        start_upsert_loader(read_message_file_stream(spark, f"{base}/in"), keyed, f"{base}/ck",
                            available_now=True).awaitTermination()
    run()
    write_lines(spark, f"{base}/in", [json.dumps({"Category": "A", "count": 1})])
    run()
    assert as_dict(keyed.read()) == {"A": 1}


def test_plain_envelopes_arrays_and_empty_snapshots(spark, scratch):
    base = scratch("plain")
    table = VersionedTable(spark, f"{base}/t")

    def load(*messages):
        return apply_snapshots(spark.createDataFrame([(m,) for m in messages], "value string").coalesce(1), table)

    load(json.dumps({"timestamp": 10, "data": [{"Category": "A", "count": 1}, {"Category": "A", "count": 2}]}))
    assert as_dict(table.read()) == {"A": 2}           # one row a category: the last entry
    load(json.dumps({"timestamp": 30, "data": [{"Category": "B", "count": 1}]}),
         json.dumps({"timestamp": 20, "data": [{"Category": "C", "count": 1}]}))
    assert as_dict(table.read()) == {"B": 1}
    load(json.dumps({"timestamp": 40, "data": []}))
    assert as_dict(table.read()) == {}
    again = spark.createDataFrame([('[{"Category": "D", "count": 4}]', 50_000_000)], "value string, seq long")
    apply_snapshots(again, table)
    assert as_dict(table.read()) == {"D": 4}


def test_existence_is_asked_of_the_default_file_system(spark, scratch):
    from orderpulse.session import _fs_path, path_exists

    root = scratch("mount")
    spark.range(1).write.parquet(f"{root}/log")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.shop.link./shared", root if "://" in root else f"file://{root}")
    conf.set("fs.defaultFS", "viewfs://shop/")
    try:
        assert path_exists(spark, "/shared/log") and not path_exists(spark, "/shared/none")
        assert "viewfs" in _fs_path(spark, "/shared/log")[0].getUri().toString()
        assert spark.read.parquet("/shared/log").count() == 1
        table = VersionedTable(spark, "/shared/t")
        table.write_version(spark.range(2).select("id"))
        assert VersionedTable(spark, "/shared/t").read().count() == 2
    finally:
        conf.set("fs.defaultFS", before)


def test_stream_result_independent_of_state_partitions(spark, scratch):
    base = scratch("invariance")
    src = f"{base}/in"
    for b in range(3):
        write_lines(spark, src, [item(b * 100 + i, "ABCDE"[(i * 7 + b) % 5]) for i in range(40)])
    results = []
    for n in (1, 4):
        table = VersionedTable(spark, f"{base}/t{n}")
        run_counts(spark, src, f"{base}/ck{n}", table, state_partitions=n)
        results.append(as_dict(table.read()))
    assert results[0] == results[1] == as_dict(category_counts(spark.read.text(src)), "Category")


def test_update_mode_publishes_changes_and_upsert_keeps_totals(spark, scratch):
    from orderpulse.streaming.category_count import object_message_sink, streaming_session

    base = scratch("update-mode")
    src = f"{base}/in"
    write_lines(spark, src, [item(1, "A"), item(2, "B"), item(3, "A")])
    write_lines(spark, src, [item(4, "A")])                       # only A changes
    job = streaming_session(spark, 2)
    q = start_category_count(read_message_file_stream(job, src, max_files_per_trigger=1),
                             f"{base}/ck", [object_message_sink(lambda m, b: write_message_batch(m, f"{base}/out", b))],
                             available_now=True, output_mode="update")
    q.awaitTermination()
    sent = sorted((r.value for r in spark.read.text(f"{base}/out").select("value").collect()))
    assert sent == ['{"Category":"A","count":2}', '{"Category":"A","count":3}', '{"Category":"B","count":1}']
    table = keyed_table(spark, f"{base}/keyed")
    up = start_upsert_loader(read_message_file_stream(spark, f"{base}/out"), table, f"{base}/ck2",
                             available_now=True)
    up.awaitTermination()
    assert as_dict(table.read()) == {"A": 3, "B": 1}


def test_crash_after_the_write_replays_without_duplicates(spark, scratch):
    import pytest

    from orderpulse.schemas import CATEGORY_COUNT
    from orderpulse.sinks.tables import read_appended
    from orderpulse.streaming.loaders import split_messages

    base = scratch("crash")
    for b in range(3):
        write_lines(spark, f"{base}/in", [json.dumps({"Category": f"C{b}", "count": b + 1}),
                                          json.dumps({"Category": "X", "count": 10 * b})])
    crash = {"armed": True}

    def sink(batch, batch_id):
        good, _ = split_messages(batch)
        append_batch(good, f"{base}/t", batch_id)
        if batch_id == 1 and crash["armed"]:      # the write landed; the batch never commits
            crash["armed"] = False
            raise RuntimeError("simulated failure after the write")

    def run():
        stream = read_message_file_stream(spark, f"{base}/in", max_files_per_trigger=1)
        return (stream.writeStream.option("checkpointLocation", f"{base}/ck")
                .foreachBatch(sink).trigger(availableNow=True).start())

    with pytest.raises(Exception):
        run().awaitTermination()
    run().awaitTermination()                       # restart: batch 1 is replayed, then batch 2
    rows = sorted((r.Category, r["count"], r.batch_id)
                  for r in read_appended(spark, f"{base}/t", CATEGORY_COUNT).collect())
    assert len(rows) == 6 and len({(c, n) for c, n, _ in rows}) == 6
    assert {b for _, _, b in rows} == {0, 1, 2}


def test_crash_before_pointer_moves_keeps_the_old_snapshot(spark, scratch):
    import pytest

    base = scratch("crash-snap")
    write_lines(spark, f"{base}/in", [item(1, "A"), item(2, "B")])
    write_lines(spark, f"{base}/in", [item(3, "A")])
    table = VersionedTable(spark, f"{base}/t")
    real_commit = VersionedTable.commit
    crash = {"armed": True}

    def flaky_commit(self, version, tag=None):
        if version == 1 and crash["armed"]:       # parts of version 1 are written, pointer not moved
            crash["armed"] = False
            assert as_dict(VersionedTable(spark, f"{base}/t").read()) == {"A": 1, "B": 1}
            raise RuntimeError("simulated failure before the pointer moves")
        real_commit(self, version, tag)

    VersionedTable.commit = flaky_commit
    try:
        with pytest.raises(Exception):
            run_counts(spark, f"{base}/in", f"{base}/ck", table)
        fresh = VersionedTable(spark, f"{base}/t")
        assert as_dict(fresh.read()) == {"A": 1, "B": 1}   # readers still see batch 0 whole
        run_counts(spark, f"{base}/in", f"{base}/ck", fresh)
    finally:
        VersionedTable.commit = real_commit
    assert as_dict(VersionedTable(spark, f"{base}/t").read()) == {"A": 2, "B": 1}


def test_an_update_rewrites_only_its_buckets(spark, scratch):
    from orderpulse.session import list_dirs
    from orderpulse.streaming.loaders import updates_of, upsert_rows

    table = keyed_table(spark, scratch("buckets"), buckets=8, keep=2)

    def merge(pairs, tag):
        lines = [(json.dumps({"Category": c, "count": n}),) for c, n in pairs]
        return table.merge(updates_of(spark.createDataFrame(lines, "value string").coalesce(1)), upsert_rows, tag)

    want = {f"c{i}": i for i in range(100)}
    assert merge(want.items(), "a") == 8
    for i in range(30):
        want[f"c{i % 3}"] = 1000 + i
        assert merge([(f"c{i % 3}", 1000 + i)], f"b{i}") == 1      # one bucket of eight
        assert merge([(f"c{i % 3}", -1)], f"b{i}") is None         # a replay writes nothing
    assert as_dict(table.read()) == want
    assert as_dict(keyed_table(spark, table.root, buckets=8).read()) == want
    folders = {n for n, _ in list_dirs(spark, table.versions)}
    assert "version=0" in folders and len(folders) < 25            # old versions of the hot buckets are gone


def test_append_loader_parses_messages_once(spark, scratch, monkeypatch):
    """Neither the entries nor the quarantine parse the messages of a batch again."""
    from orderpulse.sources.topic import read_message_file_stream
    from orderpulse.streaming import loaders

    base, plans, real = scratch("once-out"), [], loaders.append_batch

    def watched(rows, *args):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0])
        real(rows, *args)

    monkeypatch.setattr(loaders, "append_batch", watched)
    folder = scratch("once-in")
    spark.createDataFrame([('{"Category":"a","count":1}',), ("junk",), ('[{"Category":"b","count":2},{"Category":"","count":3}]',)],
                          "value string").coalesce(1).write.text(folder)
    loaders.start_append_loader(read_message_file_stream(spark, folder), f"{base}/good", f"{base}/bad", f"{base}/checkpoint",
                                available_now=True).awaitTermination()
    assert len(plans) == 2 and not any("from_json" in p for p in plans)
    assert spark.read.parquet(f"{base}/good/folder=*").count() == 2
    assert {r["reason"] for r in spark.read.parquet(f"{base}/bad/folder=*").collect()} >= {"invalid_entry"}
