"""A corpus pipeline: documents become packed training sequences in five stages.

Language identification drops documents without a letter and, if a language could be learnt, those
of which score or strangeness is out of the bounds of held-out texts; near-duplicate detection
keeps one document of each group, decontamination drops documents that hold passages of test
questions, redaction replaces personal data, and packing lays out what is left. Each stage takes
(spark, docs, sf_dir); all but the last return the columns of documents. Repeated rows of one
document are copies, so one of them stays. Null texts hold no language and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restomart.llm.common import materialize
from restomart.llm.contamination import find_contamination
from restomart.llm.language import UNKNOWN, clean_bounds, fit_language, held_out, language_udf
from restomart.llm.near_duplicates import near_duplicates
from restomart.llm.packing import pack_messages
from restomart.llm.pii import fit_detector, redact
from restomart.llm.queries import as_messages


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) and messages of which the id is unique to a document and its text."""
    return docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64("text").alias("copy")).alias("id"),
                       F.col("text").alias("content"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    examples = docs.select(F.col("text").alias("content"), F.col("lang").alias("language"))
    held = held_out(F.col("content"))
    model = fit_language(examples.filter(~held))
    if model is None:
        model = fit_language(examples)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    clean = F.lit(True)
    for length, (least, most) in sorted(clean_bounds(model, examples.filter(held)).items()):
        clean = F.when(F.length("row.text") >= length, (F.col("found.score") >= least) & (
            F.col("found.strange") <= most)).otherwise(clean)
    kept = docs.select(F.struct("*").alias("row"), language_udf(model)(F.coalesce("text", F.lit(""))).alias("found"))
    return kept.filter((F.col("found.language") != UNKNOWN) & clean).select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    kept = near_duplicates(keyed).filter("kept").select(F.col("id").alias("kept_id")).distinct()
    # A struct is equal to another with nulls in the same fields. By plain equality the rows come out dealt by id, so that
    # copies go without a second shuffle of the texts.
    return keyed.join(kept, F.col("id") == F.col("kept_id"), "left_semi").dropDuplicates(["id"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("id"), F.col("text").alias("content"))
    keyed = _keyed(docs)
    found = find_contamination(keyed, questions).filter("contaminated").select(F.col("id").alias("found_id"))
    return keyed.join(found, F.col("id").eqNullSafe(F.col("found_id")), "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = redact(docs, fit_detector(as_messages(docs)), "text")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = pack_messages(as_messages(docs), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language identification", language),
    ("near-duplicates", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]

# Sketches, learnt models and tokens are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
