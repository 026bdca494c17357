"""Queries of this subpackage: each maps the given tables to an operator and its result back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restomart.llm.contamination import find_contamination
from restomart.llm.html import extract_main_text
from restomart.llm.language import identify_language
from restomart.llm.manifest import order_manifest
from restomart.llm.near_duplicates import near_duplicates
from restomart.llm.nearest import nearest_vectors
from restomart.llm.packing import pack_messages
from restomart.llm.pii import KINDS, find_personal_data, fit_detector, spans_text
from restomart.llm.quality import score_quality
from restomart.llm.set_join import linked_messages
from restomart.llm.token_counts import message_tokens
from restomart.llm.warc import read_records, write_archives
from restomart.llm.whitening import whitened_amounts
from restomart.session import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_messages(documents: DataFrame) -> DataFrame:
    """Documents in the columns of chat messages."""
    return documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = as_messages(_table(spark, sf_dir, "documents"))
    found = find_personal_data(messages, fit_detector(messages)).drop("content")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "warc")
    index = write_archives(_table(spark, sf_dir, "pages"), root=root)
    return read_records(index, root).drop("payload")


def _fold(folds: int):
    """Remainder of the id's checksum; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    examples = documents.filter(_fold(4) != 2).select(
        F.col("text").alias("content"), F.col("lang").alias("language"))
    return identify_language(as_messages(documents), examples).select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("language").alias("lang_pred"), "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_messages(as_messages(_table(spark, sf_dir, "documents")),
                           public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(as_messages(_table(spark, sf_dir, "documents")), width=4)
    return found.withColumnRenamed("id", "doc_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("content"))
    found = find_contamination(as_messages(_table(spark, sf_dir, "documents")), questions)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = message_tokens(as_messages(_table(spark, sf_dir, "documents")),
                             public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumnRenamed("id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt = _table(spark, sf_dir, "labels").filter(_fold(5) != 0).select(
        F.col("doc_id").alias("id"), "quality")
    return score_quality(as_messages(_table(spark, sf_dir, "documents")), learnt).select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", "predicted")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest_vectors(vectors, vectors.filter("id % 20 = 0")).withColumnRenamed("id", "vec_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("amounts"))
    return whitened_amounts(vectors).withColumnRenamed("id", "vec_id")


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_messages(as_messages(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("channel"), F.col("lang").alias("source"),
        F.col("n_chars").alias("total_cents"), F.col("text").alias("raw_data"))
    changed = F.crc32(F.col("id").cast("string")) % 7 == 0
    total = F.when(changed, F.col("total_cents") + 1).otherwise(F.col("total_cents"))
    found = order_manifest(orders, ["id", "channel", "source", "total_cents", "raw_data"], {"total_cents": total})
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_html_text": op2_html_text,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_whitening": op11_whitening,
    "op12_set_join": op12_set_join,
    "op13_merkle_manifest": op13_merkle_manifest,
}
