"""Message sources: a topic broker, or message files as an offline stand-in.

Both give a streaming DataFrame with one string column ``value`` and the
arrival: ``seq`` (microseconds, from the broker timestamp or the file's
modification time), ``source`` (partition or file), ``block`` and, from the
broker, ``line`` (the offset; files are numbered in the batch). Downstream
operators are the same whichever transport is used.

The broker connector needs the ``spark-sql-kafka`` package on the cluster's
classpath; it is not installed here, so tests use the file source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topic_stream(spark: SparkSession, topic: str, bootstrap_servers: str,
                      starting_offsets: str = "latest",
                      max_offsets_per_trigger: int | None = None,
                      fail_on_data_loss: bool = True) -> DataFrame:
    """Subscribe to ``topic``. ``starting_offsets`` applies only when the
    checkpoint has no stored progress (``earliest`` or ``latest``).
    Offsets that expired from the broker stop the query unless
    ``fail_on_data_loss`` is turned off."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", topic)
              .option("startingOffsets", starting_offsets)
              .option("failOnDataLoss", str(fail_on_data_loss).lower()))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    # arrival order across partitions: the broker timestamp (offsets only
    # order messages within one partition)
    return reader.load().select(
        F.col("value").cast("string").alias("value"), F.unix_micros(F.col("timestamp")).alias("seq"),
        F.col("partition").cast("string").alias("source"), F.lit(0).cast("long").alias("block"),
        F.col("offset").alias("line"))


def read_message_file_stream(spark: SparkSession, path: str,
                             max_files_per_trigger: int | None = None,
                             max_bytes_per_trigger: int | None = None) -> DataFrame:
    """New message files under ``path``; each line is one message.

    The replay is paced (the reference sleeps 0.1 s per row) by files or by
    bytes in a micro-batch, one of the two. A batch by bytes takes the oldest
    files that fit, or one file that is larger than the limit: files are not
    split, so let the writer bound them (``write_message_files`` with
    ``max_rows``).
    """
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("give a number of files or of bytes, not both")
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    raw = reader.load(path)
    return raw.select(
        "value",
        F.unix_micros(F.col("_metadata.file_modification_time")).alias("seq"),
        F.col("_metadata.file_name").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
    )
