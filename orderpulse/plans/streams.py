"""Streaming queries over the supplied tables, run to completion.

``events`` is published as item messages into message files (the offline
stand-in for the topic), split into several files so the stream runs in
several micro-batches. Each query then runs the streaming job with
``availableNow`` in a fresh folder under the checkpoint root and returns
the sink's final content as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.functions.time import utc_to_epoch
from orderpulse.operators.snapshot import array_message, envelope_messages, envelope_rows, object_messages
from orderpulse.session import file_sizes, scratch_path
from orderpulse.sinks.messages import item_messages, write_message_batch
from orderpulse.schemas import CATEGORY_COUNT, CATEGORY_STATS, QUARANTINE
from orderpulse.sinks.tables import KeyedTable, VersionedTable, read_appended
from orderpulse.sources.files import read_message_files
from orderpulse.sources.message_log import MessageLog, committed_offsets, read_message_log
from orderpulse.sources.tables import read_table
from orderpulse.sources.topic import read_message_file_stream
from orderpulse.streaming.category_count import (
    counts_of_state, snapshot_message_sink, snapshot_table_sink, start_category_count, streaming_session,
)
from orderpulse.streaming.loaders import (
    start_append_loader, start_snapshot_loader, start_upsert_loader,
)

# Fixed parameters: messages in a file, files in a micro-batch, and the
# shuffle width of each streaming job (state partitions of the stateful ones,
# batch work of the loaders), sized for a category-like key set.
MESSAGES_PER_FILE = 200_000
FILES_PER_TRIGGER = 8
STATE_PARTITIONS = 4


def _write_split(messages: DataFrame, path: str) -> None:
    """Write message files of bounded size (no shuffle: ``maxRecordsPerFile``
    only rolls files inside each task), so a batch of ``FILES_PER_TRIGGER``
    files is bounded as well, however many there are."""
    messages.write.option("maxRecordsPerFile", MESSAGES_PER_FILE).mode("append").text(path)


def publish_events(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Item messages for every event, in several files."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"]).repartition(FILES_PER_TRIGGER + 1)
    msgs = item_messages(ev.select(F.col("event_id").alias("item_id"),
                                   F.col("event_type").alias("Category")))
    _write_split(msgs, path)


def run_category_count(spark: SparkSession, sf_dir: str, with_messages: bool, parts: int = 1) -> tuple[str, VersionedTable]:
    base = scratch_path(spark, "category-count")
    publish_events(spark, sf_dir, f"{base}/in")
    job = streaming_session(spark, STATE_PARTITIONS)
    stream = read_message_file_stream(job, f"{base}/in", FILES_PER_TRIGGER)
    table = VersionedTable(spark, f"{base}/category_stats", CATEGORY_STATS)
    sinks = [snapshot_table_sink(table)]
    if with_messages:
        sinks.append(snapshot_message_sink(
            lambda m, batch: write_message_batch(m, f"{base}/results", batch), parts=parts))
    q = start_category_count(stream, f"{base}/checkpoint", sinks, available_now=True)
    q.awaitTermination()
    return base, table


def stream_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01…05, AGG-01, SNK-07/08: final snapshot table of the running count."""
    _, table = run_category_count(spark, sf_dir, with_messages=False)
    return table.read().select(F.col("category").alias("Category"), "count")


#: rows in a message file of stream_paced_bytes, from file to file in turn, and bytes in a micro-batch
PACED_FILE_ROWS = (50, 4_000, 700)
PACED_BYTES = 400_000


def stream_paced_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06: the count over message files of very different sizes, admitted
    by bytes. Returns it with the number of micro-batches over the limit."""
    base = scratch_path(spark, "paced")
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    messages = item_messages(ev.select(F.col("event_id").alias("item_id"), F.col("event_type").alias("Category")))
    turn = F.pmod(F.xxhash64("value"), F.lit(len(PACED_FILE_ROWS)))
    for n, size in enumerate(PACED_FILE_ROWS):
        messages.where(turn == n).write.option("maxRecordsPerFile", size * max(1, ev.count() // 20_000)).mode("append").text(f"{base}/in")
    job = streaming_session(spark, STATE_PARTITIONS)
    # the limit follows the largest file, as the writer bounds files by rows
    limit = max(PACED_BYTES, *file_sizes(spark, f"{base}/in", ".txt"))
    stream = read_message_file_stream(job, f"{base}/in", max_bytes_per_trigger=limit)
    table = VersionedTable(spark, f"{base}/table", CATEGORY_STATS)
    q = start_category_count(stream, f"{base}/checkpoint", [snapshot_table_sink(table)], available_now=True)
    q.awaitTermination()
    read = _files_of_batches(spark, f"{base}/checkpoint").join(
        spark.read.format("binaryFile").load(f"{base}/in").select(F.col("path"), "length"), "path")
    over = read.groupBy("batch").agg(F.sum("length").alias("bytes")).where(F.col("bytes") > limit).count()
    return table.read().select(F.col("category").alias("Category"), "count", F.lit(over).cast("long").alias("batches_over_limit"))


def _files_of_batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, batch): which micro-batch admitted a file, by the file source's own progress log."""
    lines = spark.read.text(f"{checkpoint}/sources/0").where("value like '{%'")
    return lines.select(F.get_json_object("value", "$.path").alias("path"),
                        F.get_json_object("value", "$.batchId").cast("long").alias("batch")).distinct()


def stream_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04/05: the newest snapshot message's entries, read back."""
    base, _ = run_category_count(spark, sf_dir, with_messages=True)
    rows = envelope_rows(read_message_files(spark, f"{base}/results"))
    newest = rows.agg(F.max("snapshot_id").alias("m"))
    return (rows.join(newest, rows.snapshot_id == newest.m)
            .select("Category", F.col("count").cast("long").alias("count")))


def _reload(spark: SparkSession, base: str, results: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    job = streaming_session(spark, STATE_PARTITIONS)
    stream = read_message_file_stream(job, results, files_per_trigger)
    table = VersionedTable(spark, f"{base}/reloaded", CATEGORY_STATS)
    q = start_snapshot_loader(stream, table, f"{base}/loader-checkpoint",
                              raw_root=f"{base}/raw", available_now=True)
    q.awaitTermination()
    return table.read().select("category", "count")


def snapshot_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, SNK-08: the snapshot messages consumed by the loader into a
    versioned table; returns the committed table."""
    base, _ = run_category_count(spark, sf_dir, with_messages=True)
    return _reload(spark, base, f"{base}/results")


def snapshot_many_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: snapshots in more parts than there are categories, so that
    some parts are empty, loaded whole."""
    base, _ = run_category_count(spark, sf_dir, with_messages=True, parts=16)
    return _reload(spark, base, f"{base}/results")


def _event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_type"])
    return ev.groupBy(F.col("event_type").alias("Category")).agg(F.count(F.lit(1)).alias("count"))


def _plain_envelopes(counts: DataFrame, epoch: int) -> DataFrame:
    """``{"timestamp", "data"}`` without any part numbers."""
    body = envelope_messages(counts, 0, epoch).select(F.from_json("value", "timestamp long, data array<struct<Category:string,count:long>>").alias("b"))
    return body.select(F.to_json("b").alias("value"))


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as they are now, whatever their table holds later."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def snapshot_reload_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: plain envelopes, an array message and an empty snapshot, one
    message file in a micro-batch. The newest by timestamp is loaded, whatever
    the order of arrival."""
    base = scratch_path(spark, "reload-plain")
    counts = _event_counts(spark, sf_dir)
    _plain_envelopes(counts.withColumn("count", F.lit(0)), 1_000).write.mode("append").text(f"{base}/in")
    _plain_envelopes(counts, 4_000_000_000).coalesce(1).write.mode("append").text(f"{base}/in")
    _plain_envelopes(counts.where("false"), 2_000).write.mode("append").text(f"{base}/in")
    array_message(counts.withColumn("count", F.lit(1))).write.mode("append").text(f"{base}/in")
    return _reload(spark, base, f"{base}/in", files_per_trigger=1)


def snapshot_reload_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, SNK-08: snapshots that arrive late, one in a micro-batch: after
    a newer one, after a restart of the loader, and then a newer one. Returns
    the table after each run."""
    base = scratch_path(spark, "reload-late")
    counts = _event_counts(spark, sf_dir)

    def load(stage: str, *snapshots: tuple[int, int]) -> DataFrame:
        for epoch, more in snapshots:
            changed = counts.withColumn("count", F.col("count") + more)
            _plain_envelopes(changed, epoch).coalesce(1).write.mode("append").text(f"{base}/in")
        now = _reload(spark, base, f"{base}/in", files_per_trigger=1)
        return _kept(now.select(F.lit(stage).alias("stage"), "category", "count"), f"{base}/{stage}")

    first = load("later batch", (1_000, 1), (3_000, 3), (2_000, 2))
    second = load("after restart", (2_500, 25))
    return first.unionAll(second).unionAll(load("newer", (2_900, 29), (4_000, 4)))


def snapshot_reload_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08: an empty snapshot after a full one empties the table; returns
    the number of rows before and after."""
    base = scratch_path(spark, "reload-empty")
    counts = _event_counts(spark, sf_dir)
    _plain_envelopes(counts, 1_000).coalesce(1).write.mode("append").text(f"{base}/in")
    before = _reload(spark, base, f"{base}/in").count()
    _plain_envelopes(counts.where("false"), 2_000).coalesce(1).write.mode("append").text(f"{base}/in")
    return _reload(spark, base, f"{base}/in").agg(F.lit(before).cast("long").alias("rows_before"),
                                                  F.count(F.lit(1)).alias("rows_after"))


def stream_restart_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: the count stops, more files arrive, it resumes; then a fresh
    checkpoint counts everything again into the same table, whose newest
    version must be the one that is read."""
    base = scratch_path(spark, "restart")
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    table = VersionedTable(spark, f"{base}/table", CATEGORY_STATS)

    def count(rows: DataFrame | None, checkpoint: str) -> None:
        if rows is not None:
            item_messages(rows.select(F.col("event_id").alias("item_id"), F.col("event_type").alias("Category"))
                          ).write.mode("append").text(f"{base}/in")
        job = streaming_session(spark, STATE_PARTITIONS)
        q = start_category_count(read_message_file_stream(job, f"{base}/in", FILES_PER_TRIGGER), f"{base}/{checkpoint}",
                                 [snapshot_table_sink(table)], available_now=True)
        q.awaitTermination()

    def counted(run: str) -> DataFrame:
        rows = table.read().select(F.lit(run).alias("run"), F.col("category").alias("Category"), "count")
        return _kept(rows, f"{base}/{run}")

    count(ev.where("event_id % 2 = 0"), "first")
    half = counted("half")
    count(ev.where("event_id % 2 <> 0"), "first")
    whole = counted("resumed")
    count(None, "second")
    return half.unionAll(whole).unionAll(counted("fresh"))


def _item_values(rows: DataFrame) -> DataFrame:
    return item_messages(rows.select(F.col("event_id").alias("item_id"), F.col("event_type").alias("Category")))


def topic_start_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: two counts over one message table, one from its earliest and one
    from its latest offsets; each stops, more messages arrive, and it goes on
    from its stored offsets. Returns the counts after each run."""
    base = scratch_path(spark, "start-policy")
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    log = MessageLog(spark, f"{base}/topic")
    out = None
    for run, part in (("first", F.col("event_id") % 2 == 0), ("resumed", F.col("event_id") % 2 != 0)):
        log.append(_item_values(ev.where(part)))
        for policy in ("earliest", "latest"):
            job = streaming_session(spark, STATE_PARTITIONS)
            table = VersionedTable(spark, f"{base}/{policy}", CATEGORY_STATS)
            start_category_count(read_message_log(job, f"{base}/topic", policy), f"{base}/checkpoint-{policy}",
                                 [snapshot_table_sink(table)], available_now=True).awaitTermination()
            now = _kept(table.read().select(F.lit(policy).alias("policy"), F.lit(run).alias("run"),
                                            F.col("category").alias("Category"), "count"), f"{base}/{policy}-{run}")
            out = now if out is None else out.unionAll(now)
    return out


#: state partitions of the second query of stream_reseeded_counts
MORE_STATE_PARTITIONS = 16


def stream_reseeded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: a count stops; its state and offsets are read from its
    checkpoint, and a query with another number of state partitions goes on
    from there over the messages that came since, and once more after a stop."""
    base = scratch_path(spark, "reseeded")
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    log = MessageLog(spark, f"{base}/topic")
    old = VersionedTable(spark, f"{base}/old", CATEGORY_STATS)
    log.append(_item_values(ev.where("event_id % 3 = 0")))
    job = streaming_session(spark, STATE_PARTITIONS)
    start_category_count(read_message_log(job, f"{base}/topic", "earliest"), f"{base}/checkpoint-old",
                         [snapshot_table_sink(old)], available_now=True).awaitTermination()

    counts_of_state(spark, f"{base}/checkpoint-old").write.parquet(f"{base}/seeds")
    offsets = committed_offsets(spark, f"{base}/checkpoint-old")
    table = VersionedTable(spark, f"{base}/new", CATEGORY_STATS)
    for rest in (1, 2):
        log.append(_item_values(ev.where(F.col("event_id") % 3 == rest)))
        wide = streaming_session(spark, MORE_STATE_PARTITIONS)
        seeds = wide.readStream.schema("Category string, count long").parquet(f"{base}/seeds")
        start_category_count(read_message_log(wide, f"{base}/topic", offsets), f"{base}/checkpoint-new",
                             [snapshot_table_sink(table)], available_now=True, seeds=seeds).awaitTermination()
    states = counts_of_state(spark, f"{base}/checkpoint-new").select(F.col("Category"), F.col("count").alias("in_state"))
    return table.read().select(F.col("category").alias("Category"), "count").join(states, "Category")


# Fixed texts that look like JSON and are not.
NOT_JSON = ['{"Category":"a","count":1}] junk', "{'Category':'a','count':1}", "1],[2"]


def _append_inputs(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Object messages with per-category counts of ``events``, followed by
    every document text as a (malformed) message, line breaks folded, and
    some texts that are nearly JSON."""
    docs = read_table(spark, sf_dir, "documents", ["text"])
    junk = docs.select(F.regexp_replace("text", "[\\r\\n]", " ").alias("value"))
    near = spark.createDataFrame([(t,) for t in NOT_JSON], "value string")
    _write_split(object_messages(_event_counts(spark, sf_dir)).unionByName(junk).unionByName(near), path)


def _run_append(spark: SparkSession, sf_dir: str, publish=_append_inputs) -> str:
    base = scratch_path(spark, "append-loader")
    publish(spark, sf_dir, f"{base}/in")
    job = streaming_session(spark, STATE_PARTITIONS)
    stream = read_message_file_stream(job, f"{base}/in", FILES_PER_TRIGGER)
    q = start_append_loader(stream, f"{base}/category", f"{base}/quarantine",
                            f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return base


def _appended(spark: SparkSession, base: str) -> DataFrame:
    return read_appended(spark, f"{base}/category", CATEGORY_COUNT).select("Category", F.col("count").cast("long"))


def append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: object messages appended per batch; returns the table."""
    return _appended(spark, _run_append(spark, sf_dir))


def append_from_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: the entries of envelope messages, in parts, appended."""
    return _appended(spark, _run_append(spark, sf_dir, lambda s, d, path: _write_split(
        envelope_messages(_event_counts(s, d), 1, 0, parts=3), path)))


def append_from_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: the entries of one array message appended."""
    return _appended(spark, _run_append(spark, sf_dir, lambda s, d, path: _write_split(
        array_message(_event_counts(s, d)), path)))


#: message files of append_compacted, each a micro-batch of its own
APPEND_BATCHES = 20


def append_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: one object message per event, appended in many micro-batches;
    the table compacts its folders on the way. Returns what every category
    holds."""
    base = scratch_path(spark, "append-compacted")
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
    rows = ev.select(F.col("event_type").alias("Category"), F.col("event_id").alias("count"))
    object_messages(rows.repartition(APPEND_BATCHES, "count")).write.text(f"{base}/in")
    job = streaming_session(spark, STATE_PARTITIONS)
    files = read_message_file_stream(job, f"{base}/in", 1)
    start_append_loader(files, f"{base}/category", f"{base}/quarantine", f"{base}/checkpoint",
                        available_now=True).awaitTermination()
    return _appended(spark, base).groupBy("Category").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("count").alias("total"), F.max("count").alias("largest"))


#: commits of keyed_growth; each adds a part of the orders
KEYED_BATCHES = 4
#: buckets that the whole table of keyed_growth has, at least
KEYED_BUCKETS = 16


def keyed_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: a table keyed by order that starts as one bucket and splits
    buckets as orders arrive in several commits; then every tenth order is
    updated. Returns the table."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_custkey"])
    latest = orders.groupBy("o_orderkey").agg(F.max(F.struct("o_orderstatus", "o_custkey")).alias("o")).select("o_orderkey", "o.*")
    rows = latest.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"),
                         F.col("o_custkey").cast("long").alias("customer"), F.lit(0).alias("revision"))
    base = scratch_path(spark, "keyed-growth")
    table = KeyedTable(spark, base, rows.schema, "item_id", buckets=1, max_rows=max(1, orders.count() // KEYED_BUCKETS))

    def newest(current: DataFrame, updates: DataFrame) -> DataFrame:
        values = ["status", "customer", "revision"]
        both = current.select("item_id", *values).unionByName(updates.select("item_id", *values))
        return both.groupBy("item_id").agg(F.max_by(F.struct(*values), "revision").alias("v")).select("item_id", "v.*")

    for part in range(KEYED_BATCHES):
        table.merge(rows.where(F.pmod("item_id", F.lit(KEYED_BATCHES)) == part), newest, f"load {part}")
    changed = rows.where(F.col("item_id") % 10 == 0).select("item_id", F.lit("X").alias("status"), "customer", F.lit(1).alias("revision"))
    table.merge(changed, newest, "update")
    table.merge(changed.withColumn("revision", F.lit(2)), newest, "update")  # a replay: nothing happens
    return table.read()


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: malformed messages set aside with their reason; returns the
    count per reason."""
    base = _run_append(spark, sf_dir)
    q = read_appended(spark, f"{base}/quarantine", QUARANTINE)
    return q.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: one envelope per event (timestamp = event time, count = event
    id) merged into a keyed table. Events arrive in the order of their ids
    within a file; a second file then lowers every category's count with the
    same timestamp: per category the last message to arrive wins."""
    base = scratch_path(spark, "upsert")
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type"])

    def envelopes(rows: DataFrame) -> DataFrame:
        return rows.select(F.to_json(F.struct("timestamp", F.array(F.struct("Category", "count")).alias("data"))).alias("value"))

    first = ev.select(utc_to_epoch("ts").alias("timestamp"), F.col("event_type").alias("Category"),
                      F.col("event_id").alias("count"))
    _write_split(envelopes(first), f"{base}/in")
    table = KeyedTable(spark, f"{base}/table", CATEGORY_STATS, "category", buckets=8)

    def load() -> None:
        job = streaming_session(spark, STATE_PARTITIONS)
        q = start_upsert_loader(read_message_file_stream(job, f"{base}/in", FILES_PER_TRIGGER), table,
                                f"{base}/checkpoint", available_now=True)
        q.awaitTermination()

    load()
    newest = first.groupBy("Category").agg(F.max("timestamp").alias("timestamp"), F.min("count").alias("low"),
                                           F.max("count").alias("high"))
    pairs = newest.select("timestamp", "Category", F.explode(F.array("high", "low")).alias("count"))
    envelopes(pairs.coalesce(1).sortWithinPartitions("Category", F.desc("count"))).write.mode("append").text(f"{base}/in")
    load()
    return table.read().select("category", "count", utc_to_epoch("timestamp").alias("epoch"))


def _run_dashboard_stream(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Order items (the 19-column rows, landing as Parquet files) replayed as
    a stream into the incremental dashboard (SNK-10, STR-01…06)."""
    from orderpulse.plans.io import export_order_items
    from orderpulse.schemas import ORDER_ITEM
    from orderpulse.streaming.dashboard import start_dashboard_stream

    base = scratch_path(spark, "dashboard-stream")
    export_order_items(spark, sf_dir, f"{base}/items", MESSAGES_PER_FILE, fmt="parquet")
    job = streaming_session(spark, STATE_PARTITIONS)
    items = (job.readStream.schema(ORDER_ITEM)
             .option("maxFilesPerTrigger", str(FILES_PER_TRIGGER)).parquet(f"{base}/items"))
    table = VersionedTable(spark, f"{base}/payload")
    q = start_dashboard_stream(items, table, f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return table


def stream_dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI section of the incrementally maintained payload."""
    from orderpulse.streaming.dashboard import read_kpis

    return read_kpis(_run_dashboard_stream(spark, sf_dir))


def stream_dashboard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: every section of the incrementally maintained payload, as rows."""
    from orderpulse.plans.payload import payload_rows

    return payload_rows(_run_dashboard_stream(spark, sf_dir).read())


def stream_dashboard_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-categories section of the incrementally maintained payload."""
    from orderpulse.streaming.dashboard import read_top_categories

    return read_top_categories(_run_dashboard_stream(spark, sf_dir))
