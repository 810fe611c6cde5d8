"""Corpus pipeline: from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns the documents that go on, with the
columns of ``documents``; the last returns the pieces of the packed sequences. ``docs``
should be a written table, since the stages read it several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import mixing, near, packing, pii, quality
from tideline.llm.common import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rule nor the trees reject."""
    stats = stage(quality.measure(docs, keep=COLUMNS))
    judged = quality.judge(stats, quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.filter("kept").select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return near.unique(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    found = stage(pii.marked(docs.select(F.struct(*COLUMNS).alias("row"), "text")).select("row", F.xxhash64("text").alias("hash"), "candidates"))
    model = pii.fit(found, "hash", spans="candidates")
    masked = pii.redact(found.select("row.*", "candidates"), model, spans="candidates")
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.select(*COLUMNS, mixing.words(F.col("text")).alias("words"))
    return mixing.mixed(sized, F.col("words")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens, trees and near copies are not SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
