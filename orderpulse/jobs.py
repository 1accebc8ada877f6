"""Runnable jobs: the publisher, the counting stream, the loaders, the dashboard.

    python -m orderpulse.jobs publish  --csv items.csv --out msgs/ [--strict]
    python -m orderpulse.jobs publish  --csv users.csv --out sex/ --plain --index 9
    python -m orderpulse.jobs listen   --messages msgs/ --checkpoint ck0/
    python -m orderpulse.jobs count    --messages msgs/ --checkpoint ck/ --table stats/ [--results res/]
    python -m orderpulse.jobs reload   --messages res/ --checkpoint ck2/ --table reloaded/
    python -m orderpulse.jobs append   --messages res/ --checkpoint ck3/ --table log/ --quarantine bad/
    python -m orderpulse.jobs upsert   --messages res/ --checkpoint ck4/ --table keyed/
    python -m orderpulse.jobs dashboard --items items_dir/ --checkpoint ck5/ --table payload/
    python -m orderpulse.jobs kpis     --items items.csv

Message endpoints are folders of message files; give ``--bootstrap`` to use
a topic of that name on a broker instead. Streaming jobs run until stopped,
or process what is there and stop with ``--available-now``. Every path
should be on a shared file system; checkpoints make the jobs restartable.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession


def _messages(spark: SparkSession, args, max_per_trigger: int | None = None) -> DataFrame:
    from orderpulse.sources.topic import read_message_file_stream, read_topic_stream

    if args.bootstrap:
        return read_topic_stream(spark, args.messages, args.bootstrap, args.starting_offsets,
                                 max_offsets_per_trigger=max_per_trigger)
    return read_message_file_stream(spark, args.messages, max_files_per_trigger=max_per_trigger)


def _writer(args, target: str):
    """Messages and the name of their batch: a replayed batch rewrites its
    folder; a topic gets it again."""
    from orderpulse.sinks.messages import write_message_batch, write_topic

    if args.bootstrap:
        return lambda m, batch: write_topic(m, target, args.bootstrap)
    return lambda m, batch: write_message_batch(m, target, batch)


def _relational(args, snapshot: bool):
    """The loader's rows into a relational table, when ``--jdbc-url`` names
    one. Needs the database's driver on the classpath; there is no database
    here to run it against."""
    if not args.jdbc_url:
        return None
    from orderpulse.sinks.tables import append_jdbc, write_jdbc_snapshot

    if snapshot:
        return lambda rows, batch_id, run: write_jdbc_snapshot(rows, args.jdbc_url, args.jdbc_table)
    return lambda rows, batch_id, run: append_jdbc(rows, args.jdbc_url, args.jdbc_table, batch_id, run)


def _table(spark: SparkSession, path: str):
    from orderpulse.schemas import CATEGORY_STATS
    from orderpulse.sinks.tables import VersionedTable

    return VersionedTable(spark, path, CATEGORY_STATS)


def _run(q, args) -> None:
    q.awaitTermination()


def cmd_publish(spark: SparkSession, args) -> None:
    """CSV rows → one JSON message per row (``item_id``, stripped
    ``Category``), or with ``--plain`` one column as plain text."""
    from orderpulse.sinks.messages import item_messages, plain_messages, write_message_files, write_topic
    from orderpulse.sources.files import read_named_csv, read_positional_csv

    if args.plain:
        messages = plain_messages(read_positional_csv(spark, args.csv, args.index, args.header_value), "value")
    else:
        messages = item_messages(read_named_csv(spark, args.csv, ["item_id", "Category"]), strict=args.strict)
    if args.bootstrap:
        write_topic(messages, args.out, args.bootstrap)
    else:
        write_message_files(messages, args.out)


def cmd_listen(spark: SparkSession, args) -> None:
    """Print every raw message of a topic or folder (SNK-11)."""
    from orderpulse.sinks.messages import print_messages

    q = (_messages(spark, args, args.max_per_trigger).writeStream.option("checkpointLocation", args.checkpoint)
         .foreachBatch(lambda batch, _: print_messages(batch)))
    q = q.trigger(availableNow=True) if args.available_now else q.trigger(processingTime=args.trigger)
    _run(q.start(), args)


def cmd_count(spark: SparkSession, args) -> None:
    """The running count per category, fanned out to the snapshot table,
    the console and (optionally) snapshot messages."""
    from orderpulse.streaming.category_count import (
        console_sink, object_message_sink, snapshot_message_sink, snapshot_table_sink,
        start_category_count, streaming_session,
    )

    if args.output_mode == "complete" and not args.table:
        raise SystemExit("count: --table is required in complete mode")
    job = streaming_session(spark, args.state_partitions)
    sinks = []
    if args.output_mode == "complete":
        sinks.append(snapshot_table_sink(_table(spark, args.table)))
        if args.results:
            sinks.append(snapshot_message_sink(_writer(args, args.results), parts=args.parts))
    elif args.results:  # update mode: changed categories as object messages
        sinks.append(object_message_sink(_writer(args, args.results)))
    if args.console:
        sinks.append(console_sink())
    q = start_category_count(_messages(job, args, args.max_per_trigger), args.checkpoint, sinks,
                             trigger=args.trigger, available_now=args.available_now,
                             output_mode=args.output_mode)
    _run(q, args)


def cmd_reload(spark: SparkSession, args) -> None:
    from orderpulse.streaming.category_count import streaming_session
    from orderpulse.streaming.loaders import start_snapshot_loader

    job = streaming_session(spark, args.state_partitions)
    q = start_snapshot_loader(_messages(job, args, args.max_per_trigger), _table(spark, args.table),
                              args.checkpoint, raw_root=args.raw, available_now=args.available_now,
                              trigger=args.trigger, target=_relational(args, snapshot=True))
    _run(q, args)


def cmd_append(spark: SparkSession, args) -> None:
    from orderpulse.schemas import CATEGORY_COUNT
    from orderpulse.sinks.tables import AppendTable
    from orderpulse.streaming.category_count import streaming_session
    from orderpulse.streaming.loaders import start_append_loader

    if not args.jdbc_url:
        AppendTable(spark, args.table).ensure(CATEGORY_COUNT)
    job = streaming_session(spark, args.state_partitions)
    q = start_append_loader(_messages(job, args, args.max_per_trigger), args.table, args.quarantine, args.checkpoint,
                            available_now=args.available_now, trigger=args.trigger,
                            target=_relational(args, snapshot=False))
    _run(q, args)


def cmd_upsert(spark: SparkSession, args) -> None:
    from orderpulse.schemas import CATEGORY_STATS
    from orderpulse.sinks.tables import KeyedTable
    from orderpulse.streaming.category_count import streaming_session
    from orderpulse.streaming.loaders import start_upsert_loader

    job = streaming_session(spark, args.state_partitions)
    table = KeyedTable(spark, args.table, CATEGORY_STATS, "category")
    q = start_upsert_loader(_messages(job, args, args.max_per_trigger), table, args.checkpoint,
                            available_now=args.available_now, trigger=args.trigger,
                            target=_relational(args, snapshot=True))
    _run(q, args)


def cmd_dashboard(spark: SparkSession, args) -> None:
    """Incremental KPI payload from 19-column order-item files (CSV or Parquet)."""
    from orderpulse.schemas import ORDER_ITEM
    from orderpulse.sinks.tables import VersionedTable
    from orderpulse.streaming.category_count import streaming_session
    from orderpulse.streaming.dashboard import start_dashboard_stream

    job = streaming_session(spark, args.state_partitions)
    reader = job.readStream.schema(ORDER_ITEM)
    if args.max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(args.max_per_trigger))
    items = (reader.option("header", True).csv(args.items) if args.format == "csv"
             else reader.parquet(args.items))
    q = start_dashboard_stream(items, VersionedTable(spark, args.table),
                               args.checkpoint, refresh_every=args.trigger, available_now=args.available_now)
    _run(q, args)


def cmd_kpis(spark: SparkSession, args) -> None:
    """The home page's numbers from an order-item CSV, printed."""
    from orderpulse.operators import distributions, kpis, topk
    from orderpulse.operators.measures import with_item_measures
    from orderpulse.sinks.messages import print_rows
    from orderpulse.sources.files import read_typed_csv

    fact = with_item_measures(read_typed_csv(spark, args.items))
    kpis.kpi_summary(fact).show(truncate=False)
    topk.top_categories(fact, n=5).show(truncate=False)
    print_rows(distributions.daily_orders(fact, drop_null_keys=True))


COMMANDS = {
    "publish": cmd_publish, "listen": cmd_listen, "count": cmd_count, "reload": cmd_reload, "append": cmd_append,
    "upsert": cmd_upsert, "dashboard": cmd_dashboard, "kpis": cmd_kpis,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m orderpulse.jobs")
    sub = p.add_subparsers(dest="command", required=True)

    def common(sp, stream=True):
        sp.add_argument("--bootstrap", help="broker address; message endpoints are then topics")
        if stream:
            sp.add_argument("--checkpoint", required=True)
            sp.add_argument("--trigger", default="5 seconds")
            sp.add_argument("--available-now", action="store_true")
            sp.add_argument("--starting-offsets", default="latest", choices=["earliest", "latest"])
            sp.add_argument("--max-per-trigger", type=int)
            sp.add_argument("--state-partitions", type=int)
            sp.add_argument("--jdbc-url", help="loaders: write to this database instead of files")
            sp.add_argument("--jdbc-table", default="category_stats")
        return sp

    sp = common(sub.add_parser("publish"), stream=False)
    sp.add_argument("--csv", required=True)
    sp.add_argument("--out", required=True, help="message folder, or topic with --bootstrap")
    sp.add_argument("--strict", action="store_true", help="fail on a non-integer item_id")
    sp.add_argument("--plain", action="store_true", help="publish column --index as plain text")
    sp.add_argument("--index", type=int, default=9)
    sp.add_argument("--header-value", default="gender")
    sp = common(sub.add_parser("listen"))
    sp.add_argument("--messages", required=True)
    sp = common(sub.add_parser("count"))
    sp.add_argument("--parts", type=int, default=1, help="messages that one snapshot is split into")
    sp.add_argument("--messages", required=True)
    sp.add_argument("--table", help="snapshot table (complete mode)")
    sp.add_argument("--results", help="snapshot messages out (folder or topic)")
    sp.add_argument("--console", action="store_true")
    sp.add_argument("--output-mode", default="complete", choices=["complete", "update"],
                    help="update: publish only changed categories as object messages (feed `upsert`)")
    sp = common(sub.add_parser("reload"))
    sp.add_argument("--messages", required=True)
    sp.add_argument("--table", required=True)
    sp.add_argument("--raw")
    sp = common(sub.add_parser("append"))
    sp.add_argument("--messages", required=True)
    sp.add_argument("--table", required=True)
    sp.add_argument("--quarantine", required=True)
    sp = common(sub.add_parser("upsert"))
    sp.add_argument("--messages", required=True)
    sp.add_argument("--table", required=True)
    sp = common(sub.add_parser("dashboard"))
    sp.add_argument("--items", required=True)
    sp.add_argument("--format", default="csv", choices=["csv", "parquet"])
    sp.add_argument("--table", required=True)
    sp = sub.add_parser("kpis")
    sp.add_argument("--items", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if spark is None:
        from orderpulse.session import build_session
        spark = build_session(app_name=f"orderpulse-{args.command}")
    COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
