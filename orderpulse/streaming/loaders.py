"""Consumers of the result topic: snapshot reload, append log, keyed upsert.

Each is a streaming query with a ``foreachBatch`` callback and its own
checkpoint (the reference's two loaders shared one consumer group and so
split the topic between them instead of each seeing all of it). All read the
three message forms: envelopes, with or without part numbers, arrays of
entries, and single entries. Messages are parsed once.

* :func:`start_snapshot_loader` (STR-07, SNK-08): envelopes and arrays are
  snapshots. Parts are staged in a :class:`VersionedTable`; the newest whole
  one becomes the table, also when it is empty. Other messages go to a raw
  table (the reference printed them); tombstones are skipped.
* :func:`start_append_loader` (SNK-06, FLT-07): the entries of every form are
  appended per batch; malformed messages and entries go to a quarantine table
  with their text and reason.
* :func:`start_upsert_loader` (SNK-07): entries of any form update a keyed
  table, and the last one to arrive wins.

Arrival is (``seq``, ``source``, ``block``, ``line``) and then the position in
the message: the broker's or the file's time, the partition or file, and the
offset or the place in the file, so it is the same when a batch is replayed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderpulse.functions.json import SHAPE_ARRAY, SHAPE_ENVELOPE
from orderpulse.functions.time import epoch_to_utc
from orderpulse.operators.snapshot import latest_per_key, parsed_messages
from orderpulse.sinks.tables import KeyedTable, VersionedTable, append_batch

#: rows, batch id, run
RowSink = Callable[[DataFrame, int, str], None]
#: messages of a batch for each file that an append loader writes
FILE_ROWS = 1_000_000


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of this checkpoint: the same after a
    restart, another one for a fresh checkpoint."""
    return spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def _start(stream: DataFrame, checkpoint: str, callback: Callable[[DataFrame, int, str], None], available_now: bool,
           trigger: str) -> StreamingQuery:
    known: dict[str, str] = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        if "run" not in known:
            known["run"] = run_id(batch.sparkSession, checkpoint)
        callback(with_lines(batch), batch_id, known["run"])

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


ARRIVAL = {"seq": "long", "source": "string", "block": "long", "line": "long"}


def with_lines(batch: DataFrame) -> DataFrame:
    """Arrival columns that the source did not give. Ids inside a partition
    follow the lines of a file block."""
    out = batch
    for name, kind in ARRIVAL.items():
        if name not in batch.columns:
            out = out.withColumn(name, F.monotonically_increasing_id() if name == "line" else
                                 F.lit("" if kind == "string" else 0).cast(kind))
    return out


def _good(entry: Column) -> Column:
    return entry["Category"].isNotNull() & (entry["Category"] != "") & entry["count"].isNotNull()


def snapshot_parts_of(batch: DataFrame, batch_id: int = 0) -> DataFrame:
    """(snapshot, part, parts, data) for the snapshots in ``batch``.

    ``snapshot`` sorts by time, then arrival: the envelope's timestamp and
    its id, or for messages without one the arrival. An array has no
    timestamp and takes the arrival time. Entries without a category or
    count are dropped, so ``data`` may be empty: that is an empty snapshot,
    not a missing one."""
    parsed = parsed_messages(with_lines(batch)).where(F.col("shape").isin(SHAPE_ENVELOPE, SHAPE_ARRAY))
    seconds = F.coalesce("epoch", F.floor(F.col("seq") / 1_000_000))
    arrival = F.concat(F.format_string("%020d-%010d-", F.col("seq"), F.lit(batch_id).cast("long")), F.md5("source"),
                       F.format_string("-%015d-%015d", F.col("block"), F.col("line")))
    own = F.when(F.col("snapshot_id").isNotNull(), F.format_string("%020d", F.col("snapshot_id"))).otherwise(
        F.concat(F.lit("x"), arrival))
    rows = parsed.select(
        F.concat(F.format_string("%015d-", seconds), own).alias("snapshot"), "part", "parts", arrival.alias("arrival"),
        epoch_to_utc(seconds).alias("timestamp"), F.filter("entries", _good).alias("entries"))
    # a part sent twice counts as it was sent last
    single = rows.groupBy("snapshot", "part").agg(
        F.max_by(F.struct("parts", "timestamp", "entries"), "arrival").alias("m")).select("snapshot", "part", "m.*")
    return single.select("snapshot", "part", "parts", F.transform("entries", lambda e: F.struct(
        e["Category"].alias("category"), e["count"].cast("long").alias("count"), F.col("timestamp").alias("timestamp"),
        F.current_timestamp().alias("updated_at"))).alias("data"))


def apply_snapshots(batch: DataFrame, table: VersionedTable, raw_root: str | None = None,
                    batch_id: int = 0, run: str = "", target: RowSink | None = None) -> int | None:
    """Stage every snapshot part of this batch and commit the newest whole
    snapshot. Returns the committed version, if any. ``target`` gets the
    table's rows after a commit (for example a relational table)."""
    batch = batch.persist()
    try:
        table.stage(snapshot_parts_of(batch, batch_id))
        if raw_root:
            parsed = parsed_messages(batch)
            raw = parsed.where(~F.col("shape").isin(SHAPE_ENVELOPE, SHAPE_ARRAY))
            append_batch(raw.select("value", "shape"), raw_root, batch_id, run)
        version = table.commit_complete()
        if version is not None and target is not None:
            target(table.read(), batch_id, run)
        return version
    finally:
        batch.unpersist()


def start_snapshot_loader(messages: DataFrame, table: VersionedTable, checkpoint: str,
                          raw_root: str | None = None, available_now: bool = False,
                          trigger: str = "500 milliseconds", target: RowSink | None = None) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int, run: str) -> None:
        apply_snapshots(batch, table, raw_root, batch_id, run, target)
    return _start(messages, checkpoint, run, available_now, trigger)


def split_messages(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, quarantine) of messages of any form; tombstones are skipped.
    An empty snapshot has no entries and is no error."""
    return split_parsed(parsed_messages(batch))


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``split_messages`` of messages that are parsed already."""
    entries = parsed.select("value", F.explode("entries").alias("e"))
    good, bad = entries.where(_good(F.col("e"))), entries.where(~F.coalesce(_good(F.col("e")), F.lit(False)))
    unread = parsed.where(F.col("entries").isNull()).select("value", F.col("shape").alias("reason"))
    return good.select("e.Category", "e.count"), unread.unionByName(
        bad.select("value", F.lit("invalid_entry").alias("reason")))


def start_append_loader(messages: DataFrame, table_root: str, quarantine_root: str,
                        checkpoint: str, available_now: bool = False,
                        trigger: str = "1 second", target: RowSink | None = None) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int, run: str) -> None:
        # a file of messages may be one split: all cores parse, and what is parsed is kept,
        # because each filter over it would parse the messages again
        cores = batch.sparkSession.sparkContext.defaultParallelism
        parsed = parsed_messages(batch.select("value").repartition(cores)).select("value", "shape", "entries").persist()
        try:
            files = max(1, min(cores, -(-parsed.count() // FILE_ROWS)))
            good, bad = (rows.coalesce(files) for rows in split_parsed(parsed))
            if target is None:
                append_batch(good, table_root, batch_id, run)
            else:
                target(good, batch_id, run)
            append_batch(bad, quarantine_root, batch_id, run)
        finally:
            parsed.unpersist()
    return _start(messages, checkpoint, run, available_now, trigger)


def upsert_rows(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge updates into the keyed table: per category the last update to
    arrive wins over the other ones and over the current row."""
    kinds = ARRIVAL | {"entry": "int"}
    cur = current.select("category", "count", "timestamp", F.lit(False).alias("new"),
                         *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
    upd = updates.select("category", "count", "timestamp", F.lit(True).alias("new"),
                         *[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    merged = latest_per_key(cur.unionByName(upd), "category", ["new", *kinds], ["count", "timestamp"])
    return merged.select("category", "count", "timestamp", F.current_timestamp().alias("updated_at"))


def updates_of(batch: DataFrame) -> DataFrame:
    """The entries of a batch with their arrival. An entry without a
    timestamp of its own takes the arrival time, not the time of processing,
    so a replay writes the same row."""
    parsed = parsed_messages(with_lines(batch))
    rows = parsed.select("epoch", *ARRIVAL, F.posexplode("entries").alias("entry", "e")).where(_good(F.col("e")))
    seconds = F.coalesce("epoch", F.floor(F.col("seq") / 1_000_000))
    return rows.select(F.col("e.Category").alias("category"), F.col("e.count").cast("long").alias("count"),
                       epoch_to_utc(seconds).alias("timestamp"), *ARRIVAL, "entry")


def start_upsert_loader(messages: DataFrame, table: KeyedTable, checkpoint: str,
                        available_now: bool = False, trigger: str = "1 second",
                        target: RowSink | None = None) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int, run: str) -> None:
        updates = updates_of(batch).persist()
        try:
            if table.merge(updates, upsert_rows, f"{run} {batch_id}") and target is not None:
                target(table.read(), batch_id, run)
        finally:
            updates.unpersist()
    return _start(messages, checkpoint, run, available_now, trigger)
