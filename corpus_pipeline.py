"""A training-data pipeline over ``documents``: quality, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet in the
shared folder and hands it, read again, to the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, packing, quality, simhash, suffix_dedup
from tessera.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the learned decision list reject."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select(F.struct("*").alias("row"), "text"), rules)
    return judged.filter("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those mostly in scripts that no learned language is written in."""
    model = langid.fit(langid.training_rows(langid.with_split(docs)))
    return langid.predict(docs, model).filter("lang_pred <> 'und' and unseen <= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates (five-word shingles)."""
    return simhash.keep_one(docs, words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out 100-byte strings that start earlier too; n_chars follows, and documents that end up empty go."""
    names = docs.columns
    found = suffix_dedup.deduplicate(docs, length=100)
    own = {"text": F.when(F.col("row.text").isNotNull(), F.col("text")), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    kept = found.filter("n_removed = 0 or text <> ''")
    return kept.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in names))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]
#: Learned rules, fingerprints and packing have no SQL form; tests/llm/test_stages.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
