"""Message tables: offsets, start policies, ranges across segments, hand-over."""

import json

import pytest

from orderpulse.sources.message_log import MessageLog, MessageLogReader, committed_offsets, read_message_log
from orderpulse.streaming.category_count import counts_of_state, start_category_count


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(reader, start, end):
    return [r for part in reader.partitions(start, end) for r in reader.read(part)]


def test_offsets_are_gapless_over_segments(spark, scratch):
    log = MessageLog(spark, scratch("log"), partitions=3)
    assert log.append(frame(spark, "a", "b", "c", "d", "a")) == log.log.head()[1]["next"]
    end = log.append(frame(spark, "e", "a", "f"))
    assert sum(end.values()) == 8
    assert log.append(frame(spark).limit(0)) == end          # nothing new
    reader = MessageLogReader(log.root, "earliest")
    assert reader.latestOffset() == end and reader.initialOffset() == {"0": 0, "1": 0, "2": 0}
    found = rows(reader, reader.initialOffset(), end)
    assert sorted(v for v, *_ in found) == ["a", "a", "a", "b", "c", "d", "e", "f"]
    for p, n in end.items():
        assert [offset for _, _, source, _, offset in found if source == p] == list(range(n))
    # any range, also across two segments, holds its offsets once
    for p, n in end.items():
        for low in range(n + 1):
            for high in range(low, n + 1):
                part = rows(reader, {**end, p: low}, {**end, p: high})
                assert [r[4] for r in part] == list(range(low, high))
    assert rows(reader, end, end) == []


def test_start_policies(spark, scratch):
    log = MessageLog(spark, scratch("policy"), partitions=2)
    assert MessageLogReader(log.root, "latest").initialOffset() == {} == MessageLogReader(log.root, "earliest").latestOffset()
    end = log.append(frame(spark, *"abcdef"))
    assert MessageLogReader(log.root, "latest").initialOffset() == end
    assert MessageLogReader(log.root, json.dumps({"1": 2})).initialOffset() == {"0": 0, "1": 2}
    with pytest.raises(ValueError):
        read_message_log(spark, log.root, "newest")


def test_two_writers_keep_their_messages(spark, scratch):
    root = scratch("writers")
    one, two = MessageLog(spark, root, 2), MessageLog(spark, root, 2)
    real = one.log.add

    def late(number, entry):
        one.log.add = real
        two.append(frame(spark, "x", "y"))                   # the other writer is faster
        return real(number, entry)

    one.log.add = late
    end = one.append(frame(spark, "a", "b", "c"))
    reader = MessageLogReader(root, "earliest")
    assert sorted(v for v, *_ in rows(reader, reader.initialOffset(), end)) == ["a", "b", "c", "x", "y"]


def test_a_count_goes_on_with_more_state_partitions(spark, scratch):
    from orderpulse.streaming.category_count import streaming_session

    base = scratch("handover")
    log = MessageLog(spark, f"{base}/topic", 2)
    message = lambda i, c: json.dumps({"item_id": i, "Category": c})
    got = {}

    def run(partitions, checkpoint, start, seeds=None):
        job = streaming_session(spark, partitions)
        sink = lambda batch, batch_id, run: got.update({r["Category"]: r["count"] for r in batch.collect()})
        stream = None if seeds is None else job.readStream.schema("Category string, count long").parquet(seeds)
        start_category_count(read_message_log(job, f"{base}/topic", start), f"{base}/{checkpoint}", [sink],
                             available_now=True, seeds=stream).awaitTermination()

    log.append(frame(spark, *[message(i, "ABC"[i % 3]) for i in range(9)]))
    run(2, "old", "earliest")
    assert got == {"A": 3, "B": 3, "C": 3} and sum(committed_offsets(spark, f"{base}/old").values()) == 9
    counts_of_state(spark, f"{base}/old").write.parquet(f"{base}/seeds")
    got.clear()
    log.append(frame(spark, message(9, "A"), message(10, "D")))
    for _ in range(2):                                       # a second start adds nothing
        run(5, "new", committed_offsets(spark, f"{base}/old"), f"{base}/seeds")
    assert {r["Category"]: r["count"] for r in counts_of_state(spark, f"{base}/new").collect()} == {"A": 4, "B": 3, "C": 3, "D": 1}
    state = spark.read.format("statestore").load(f"{base}/new")
    assert state.select("partition_id").distinct().count() <= 5
    assert committed_offsets(spark, f"{base}/none") == {}
