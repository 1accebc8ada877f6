"""Corpus pipeline: quality filter, line dedup, near-dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. ``run`` applies them to ``documents``.

Defined results: a null, empty or wordless text with an id is rejected by the first
stage. Rows with a null id are scored but never trusted, and pass every later
stage as they are: they lose no line, have no class and so stay, are mixed and
packed. Of rows that repeat an id with an equal text, one stays after the near-
duplicate stage; a text of any length is worked whole. A null source or
language is one of its own. Other columns than those of ``documents`` are
dropped by the first stage, and a missing one is null. An empty table gives an
empty result. Ties (equal texts) leave the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderpulse.llm import line_dedup, mixing, near_dup, packing, quality
from orderpulse.llm.common import materialize, shuffle_partitions, table

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; one that ``docs`` lacks is null."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return as_documents(quality.keep_good(as_documents(docs), table(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that another document holds; ``n_chars`` follows.
    Every document stays, also one that has lost all its lines."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dup.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture."""
    mixed = mixing.mix(docs)
    return (mixed.repartitionByRange(shuffle_partitions(spark), "mix_slot", "mix_offset")
            .sortWithinPartitions("mix_slot", "mix_offset").select(*COLUMNS))


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs``, as read from files, with ``place``: the row's number by file
    (by the number in its name, so also beyond 100,000 files) and row."""
    rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    number = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file, and the stage before writes one file a shuffle partition
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(F.col("_file").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    return rows.join(starts, F.col("_file") == F.col("_of")).withColumn("place", F.col("_begin") + F.col("_row")).drop(
        "_file", "_row", "_of", "_begin")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences follow the mixture, that is the order of the rows in their files."""
    from public_tokenizers import path

    return packing.pack(in_file_order(docs), path("byte_bpe_50k.json"), order_col="place")


STAGES = [
    ("quality", filter_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: tokenisation, the language model and the near-duplicate classes are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
