"""The running count of items per category (the reference's streaming job).

One streaming query: messages → parse (``$.item_id``, ``$.Category``) →
drop empty categories → ``groupBy(Category).count()`` in complete mode →
one ``foreachBatch`` that fans the batch's result out to every sink.

The reference ran two queries over the same aggregate (console and topic),
so it kept the state twice and could emit different counts to the two
sinks; here the state is kept once and every sink sees the same batch.

Fault tolerance: the aggregate's state and the source progress live in the
checkpoint (a shared folder). A sink gets the batch id and the id of the
query; tables and message files use them to make a replayed batch rewrite,
not duplicate. A topic cannot take a message back: there a batch replayed
after a failure is sent again, and the loaders bear that.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderpulse.operators.cleaning import parse_item_messages, valid_categories
from orderpulse.operators.snapshot import envelope_messages
from orderpulse.sinks.messages import print_rows
from orderpulse.sinks.tables import VersionedTable

#: result rows, batch id, id of the query
BatchSink = Callable[[DataFrame, int, str], None]
#: messages, name of the batch (the same for a replay)
MessageWriter = Callable[[DataFrame, str], None]

DEFAULT_TRIGGER = "5 seconds"


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for one streaming job, sharing ``spark``'s context.

    A stateful query keeps its state in ``spark.sql.shuffle.partitions``
    partitions, fixed in the checkpoint at first start. The right number
    follows the number of *keys* (here: categories), not the data volume,
    and a batch-sized value (thousands on a large cluster) would make every
    micro-batch run thousands of tiny state tasks. Build the stream's
    source on the returned session to give the job its own count.
    """
    if not state_partitions:
        return spark
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return s


def category_counts(messages: DataFrame, value: str = "value") -> DataFrame:
    """Running count per category (AGG-01). Works for batch and stream."""
    parsed = parse_item_messages(messages, value)
    return valid_categories(parsed).groupBy("Category").count()


def counts_of_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(Category, count): the state of a counting query after its last
    committed batch, read from its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    number = state.schema["value"].dataType.names[0]  # count, or the sum of a reseeded count
    return state.select(F.col("key.Category").alias("Category"), F.col("value").getField(number).cast("long").alias("count"))


def reseeded_counts(messages: DataFrame, seeds: DataFrame, value: str = "value") -> DataFrame:
    """Running count that goes on from the counts of another query: ``seeds``
    is a stream of (Category, count), ``messages`` the messages after it. The
    number of state partitions is this query's own."""
    fresh = valid_categories(parse_item_messages(messages, value)).select("Category", F.lit(1).cast("long").alias("count"))
    both = fresh.unionByName(seeds.select("Category", F.col("count").cast("long").alias("count")))
    return both.groupBy("Category").agg(F.sum("count").alias("count"))


def fan_out(sinks: Sequence[BatchSink], checkpoint: str) -> Callable[[DataFrame, int], None]:
    """One batch callback that feeds every sink the same cached result."""
    from orderpulse.streaming.loaders import run_id

    known: dict[str, str] = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        if "run" not in known:
            known["run"] = run_id(batch.sparkSession, checkpoint)
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id, known["run"])
        finally:
            batch.unpersist()
    return run


def console_sink() -> BatchSink:
    """Print the whole result table (SNK-03)."""
    def run(batch: DataFrame, batch_id: int, run: str = "") -> None:
        print(f"-- batch {batch_id}")
        print_rows(batch)
    return run


def snapshot_table_sink(table: VersionedTable) -> BatchSink:
    """Atomically replace the snapshot table with this batch's counts
    (SNK-07/08/09). The version is tagged with query and batch, so a replay
    writes nothing new."""
    from orderpulse.functions.time import epoch_to_utc

    def run(batch: DataFrame, batch_id: int, run: str = "") -> None:
        rows = batch.select(F.col("Category").alias("category"),
                            F.col("count").cast("long").alias("count"),
                            epoch_to_utc(F.unix_seconds(F.current_timestamp())).alias("timestamp"),
                            F.current_timestamp().alias("updated_at"))
        table.write_version(rows, f"{run} {batch_id}")
    return run


def snapshot_message_sink(write: MessageWriter, parts: int = 1,
                          clock: Callable[[], float] = time.time) -> BatchSink:
    """Publish the batch as ``parts`` snapshot envelope messages (SNK-04/05).

    Choose ``parts`` for the number of categories that one message should
    hold; it does not change with the data. An empty batch sends nothing, as
    in the reference.
    """
    def run(batch: DataFrame, batch_id: int, run: str = "") -> None:
        if not batch.isEmpty():
            write(envelope_messages(batch, batch_id, int(clock()), parts), f"{run}-{batch_id}")
    return run


def object_message_sink(write: MessageWriter) -> BatchSink:
    """Publish each result row as an object message ``{Category, count}``.

    With ``output_mode="update"`` a batch holds only the categories whose
    count changed, so the messages per trigger follow the changes, not the
    number of categories; the upsert loader keeps the keyed table."""
    from orderpulse.operators.snapshot import object_messages

    def run(batch: DataFrame, batch_id: int, run: str = "") -> None:
        write(object_messages(batch), f"{run}-{batch_id}")
    return run


def start_category_count(messages: DataFrame, checkpoint: str, sinks: Sequence[BatchSink],
                         trigger: str | None = DEFAULT_TRIGGER, available_now: bool = False,
                         query_name: str | None = None, output_mode: str = "complete",
                         seeds: DataFrame | None = None) -> StreamingQuery:
    """Start the counting query (STR-01…05).

    ``trigger`` is the processing-time interval (the reference used 5 s);
    ``available_now`` processes what is there in bounded batches and stops.
    ``output_mode``: ``complete`` (the reference's; every batch carries the
    whole count table, which the snapshot sinks need) or ``update`` (only
    changed categories; pair it with :func:`object_message_sink`). With
    ``seeds`` the count goes on from another query's (``reseeded_counts``).
    """
    if output_mode not in ("complete", "update"):
        raise ValueError("output_mode must be 'complete' or 'update'")
    counts = category_counts(messages) if seeds is None else reseeded_counts(messages, seeds)
    writer = (counts.writeStream.outputMode(output_mode)
              .option("checkpointLocation", checkpoint)
              .foreachBatch(fan_out(sinks, checkpoint)))
    if query_name:
        writer = writer.queryName(query_name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
