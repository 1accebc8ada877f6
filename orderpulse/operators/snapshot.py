"""Category-count snapshots: build the messages, read them back, merge.

A snapshot is the full running count table at one micro-batch. It is sent as
``parts`` envelope messages, split by a hash of the category; ``parts`` is a
setting of the producer, not a function of the data, and a part without
entries is sent as well, so a consumer that has seen ``parts`` messages has
the whole snapshot. The envelope keeps the ``timestamp`` and ``data`` fields
of the plain form and adds ``snapshot_id``, ``part`` and ``parts``; a plain
envelope, ``{timestamp, data}``, and the array form ``[{Category, count}]``
are read as snapshots of one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.json import (
    SHAPE_ARRAY, SHAPE_ENVELOPE, SHAPE_OBJECT, snapshot_entries, snapshot_shape,
)
from orderpulse.functions.text import is_present
from orderpulse.functions.time import epoch_to_utc
from orderpulse.schemas import SNAPSHOT_ENVELOPE


def _entries(counts: DataFrame, category: str, count: str) -> DataFrame:
    rows = counts.where(is_present(category) & F.col(count).isNotNull())
    return rows.select(F.struct(F.col(category).alias("Category"), F.col(count).cast("long").alias("count")).alias("e"))


def envelope_messages(counts: DataFrame, snapshot_id: int | Column, timestamp: int | Column,
                      parts: int = 1, category: str = "Category", count: str = "count") -> DataFrame:
    """``parts`` snapshot envelope messages (``value``) for a count table.

    Each part is put together by its own task. Rows without a category or
    count are left out (FLT-02); a part may have no entries.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    entries = _entries(counts, category, count)
    part = F.pmod(F.xxhash64("e.Category"), F.lit(parts)).cast("int")
    filled = entries.select(part.alias("part"), "e")
    every = counts.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(None).alias("e"))
    grouped = filled.unionByName(every).groupBy("part").agg(F.sort_array(F.collect_list("e")).alias("data"))
    sid = snapshot_id if isinstance(snapshot_id, Column) else F.lit(snapshot_id)
    ts = timestamp if isinstance(timestamp, Column) else F.lit(timestamp)
    body = F.struct(ts.cast("long").alias("timestamp"), sid.cast("long").alias("snapshot_id"),
                    F.col("part"), F.lit(parts).cast("int").alias("parts"), F.col("data"))
    return grouped.select(F.to_json(body).alias("value"))


def array_message(counts: DataFrame, category: str = "Category", count: str = "count") -> DataFrame:
    """The array form ``[{Category, count}]``: one message, whose size follows
    the number of categories (the form has no field to number parts)."""
    return _entries(counts, category, count).agg(F.to_json(F.sort_array(F.collect_list("e"))).alias("value"))


def object_messages(counts: DataFrame, category: str = "Category", count: str = "count") -> DataFrame:
    """The object form ``{Category, count}``: one message per category."""
    return _entries(counts, category, count).select(F.to_json("e").alias("value"))


def route_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``shape`` and ``route``: envelopes load the snapshot table; every
    other shape goes to the raw branch (the reference prints them); a
    tombstone is skipped."""
    shape = snapshot_shape(value)
    route = (F.when(shape == SHAPE_ENVELOPE, F.lit("load"))
             .when(shape == "tombstone", F.lit("skip"))
             .otherwise(F.lit("raw")))
    return messages.select("*", shape.alias("shape")).withColumn("route", route)


def parsed_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Every message that is not a tombstone, parsed once: ``shape``,
    ``entries`` (null for shapes without any), ``epoch``, ``snapshot_id``,
    ``part`` and ``parts``. A message that is not split is part 0 of 1."""
    kept = messages.where(F.col(value).isNotNull())
    shaped = kept.select("*", snapshot_shape(value).alias("shape"))
    env = F.when(F.col("shape") == SHAPE_ENVELOPE, F.from_json(F.col(value), SNAPSHOT_ENVELOPE))
    read = shaped.withColumn("_env", env)
    other = F.when(F.col("shape").isin(SHAPE_ARRAY, SHAPE_OBJECT), snapshot_entries(F.col(value), F.col("shape")))
    return read.select(
        *shaped.columns, F.coalesce(F.col("_env.data"), other).alias("entries"), F.col("_env.timestamp").alias("epoch"),
        F.col("_env.snapshot_id").alias("snapshot_id"), F.coalesce(F.col("_env.part"), F.lit(0)).alias("part"),
        F.coalesce(F.col("_env.parts"), F.lit(1)).alias("parts"))


def explode_entries(routed: DataFrame, value: str = "value") -> DataFrame:
    """One row per (message, entry) for envelope, array and object shapes,
    with the envelope's snapshot fields (null for the other shapes)."""
    base = [c for c in routed.columns if c != "shape"]
    parsed = parsed_messages(routed.select(*base), value)
    exploded = parsed.select(*base, "shape", "snapshot_id", "part", "parts", "epoch", F.posexplode("entries").alias("entry", "_e"))
    return exploded.select("*", F.col("_e.Category").alias("Category"), F.col("_e.count").alias("count")).drop("_e")


def envelope_rows(messages: DataFrame, value: str = "value") -> DataFrame:
    """Snapshot rows carried by envelope messages: snapshot_id, part, parts,
    epoch, timestamp (UTC), Category, count."""
    rows = explode_entries(route_messages(messages, value), value).where(F.col("shape") == SHAPE_ENVELOPE)
    return rows.select("snapshot_id", "part", "parts", "epoch",
                       epoch_to_utc("epoch").alias("timestamp"), "Category", "count")


def latest_per_key(rows: DataFrame, key: str, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Keyed upsert, last write wins: per ``key`` keep the values of the row
    with the greatest ``order_cols`` (SNK-07).

    ``max_by`` is an ordinary aggregate: it is combined partially on the map
    side, so a key that receives a third of all updates still reaches the
    shuffle as one row per task.
    """
    out_cols = list(dict.fromkeys(value_cols + order_cols))
    order = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in out_cols])
    agg = rows.groupBy(key).agg(F.max_by(payload, order).alias("_latest"))
    return agg.select(key, *[F.col(f"_latest.{c}").alias(c) for c in out_cols])
