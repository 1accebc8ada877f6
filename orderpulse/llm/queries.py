"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.llm import (
    fill_middle,
    html_text,
    imatch,
    language_id,
    lattice_lm,
    license_scan,
    line_dedup,
    mixing,
    near_dup,
    packing,
    prefix_trie,
    quality,
    topk,
)
from orderpulse.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return license_scan.summarize(scanned, ["doc_id"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source")).drop("source_rank")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.fit(docs.where(fold != 1), "text", "lang")
    rows = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    return language_id.predict(rows, model, "text", "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = docs.withColumns({"held_out": F.coalesce(fold == 1, F.lit(False)), "learn": fold != 1})
    scored = lattice_lm.score_documents(rows, "learn", path("piece_bpe_32k.model"), class_col="lang")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.share_heads(prefix_trie.paths_of(turns)))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_middle.transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    restored = fill_middle.rebuild(F.col("text"), F.col("form"))
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"),
                       F.sha2(restored, 256).alias("restored_sha256"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_near_dup": op2_near_dup,
        "op3_html_text": op3_html_text,
        "op4_fingerprints": op4_fingerprints,
        "op5_top_k": op5_top_k,
        "op6_license_scan": op6_license_scan,
        "op7_packing": op7_packing,
        "op8_mixing": op8_mixing,
        "op9_language_id": op9_language_id,
        "op10_line_dedup": op10_line_dedup,
        "op11_lattice_lm": op11_lattice_lm,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_fill_middle": op13_fill_middle,
    }
