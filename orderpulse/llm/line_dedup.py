"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded with their position, normalised and hashed; the number of
distinct documents per hash decides which keys go; the positions to drop are
joined back to the documents, which are reassembled by position. Built-in
functions only. Text crosses the network once (in the last join); lines are
cut and hashed once, into a table of positions and hashes, and the hot lines
travel as hashes: the count is aggregated before its shuffle and the
join that finds the lines to drop is an exchange on both sides, which
adaptive execution splits when a line is very common.

Defined results: a null or empty text is one empty line. Rows that share a
``doc_id`` are one document for the count and for the holder of a line; each
row is returned. Rows with a null ``doc_id`` have no identity: they are
neither counted nor changed. Ties do not arise (the largest id holds a line).
An empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import isolate, materialize, restore, spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.
    A line of single-byte characters only takes the faster ``lower``."""
    body = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(body) == F.char_length(body), F.lower(body)).otherwise(
        F.translate(body, UPPER, UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, plus ``n_lines`` (before) and
    ``n_dropped``. Keys of at least ``min_chars`` code points found in at
    least ``min_docs`` documents lose all lines except in the document with
    the largest id that holds them."""
    roles = {"id": id_col, "text": text_col}
    rows = isolate(docs, **roles)
    text = F.col("text")
    own = F.xxhash64(text)  # tells apart rows that share an id
    long_lines = materialize(
        rows.where(F.col("id").isNotNull() & (F.char_length(text) >= min_chars))
        .select("id", own.alias("own"), F.posexplode(_lines(text)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "own", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "own", "pos", F.unhex(F.md5("key")).alias("h")), "lines")
    shared = (
        long_lines.groupBy("h").agg(F.countDistinct("id").alias("n"), F.max("id").alias("holder"))
        .where(F.col("n") >= min_docs)
        .select(F.col("h").alias("sh"), "holder")
    )
    drops = (
        long_lines.join(spread(shared), (F.col("h") == F.col("sh")) & (F.col("id") != F.col("holder")))
        .groupBy(F.col("id").alias("did"), F.col("own").alias("down"))
        .agg(F.collect_list("pos").alias("gone"))
    )
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), text).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n"))
    done = rows.join(drops, (F.col("id") == F.col("did")) & (own == F.col("down")), "left").withColumn(
        "lines", _lines(text)).withColumn("kept", kept)
    return restore(
        done, docs, {"id": id_col, "kept": text_col}, n_lines=F.size("lines").cast("long"),
        n_dropped=F.coalesce(F.size(F.array_distinct("gone")), F.lit(0)).cast("long"))
