"""Message sinks: JSON or plain-text messages to a topic or to files.

SNK-01 publishes ``{"item_id", "Category"}`` per row, SNK-02 one column as
plain text, SNK-11 prints raw messages. Messages are encoded on the
executors (``to_json``) and written by the executors; nothing is gathered on
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.text import py_strip, strict_long


def item_messages(df: DataFrame, item_id: str = "item_id", category: str = "Category",
                  strict: bool = True) -> DataFrame:
    """``{"item_id": long, "Category": stripped string}`` per row.

    ``strict``: a bad integer id fails the job, as the reference's
    publisher stops on it. Otherwise a bad id becomes null and the row is
    still published (the consumer quarantines it).
    """
    iid = strict_long(item_id, "item_id") if strict else F.col(item_id).try_cast("long")
    return df.select(F.to_json(F.struct(iid.alias("item_id"),
                                        py_strip(category).alias("Category"))).alias("value"))


def plain_messages(df: DataFrame, column: str) -> DataFrame:
    """One column as plain text messages."""
    return df.select(F.col(column).cast("string").alias("value"))


def write_message_files(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``value`` lines as text files (one file per task)."""
    messages.select("value").write.mode(mode).text(path)


def write_message_batch(messages: DataFrame, path: str, batch: str) -> None:
    """Write one batch's messages to a folder of their own below ``path``;
    writing the batch again replaces them, so a replay sends nothing twice."""
    messages.select("value").write.mode("overwrite").text(f"{path.rstrip('/')}/batch={batch}")


def write_topic(messages: DataFrame, topic: str, bootstrap_servers: str) -> None:
    """Publish ``value`` (and ``key`` if present) to a topic."""
    cols = ["value"] + (["key"] if "key" in messages.columns else [])
    (messages.select(*cols).write.format("kafka")
     .option("kafka.bootstrap.servers", bootstrap_servers)
     .option("topic", topic).save())


def print_rows(rows: DataFrame) -> None:
    """Print every row, whole. Rows come to the driver one partition at a
    time, so printing needs the memory of the largest partition only."""
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def print_messages(messages: DataFrame) -> None:
    """Print every raw message (SNK-11)."""
    print_rows(messages.select(F.col("value").cast("string").alias("value")))
