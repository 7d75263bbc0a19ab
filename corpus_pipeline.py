"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing, each over all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmeter.llm import langid, mixing, packing, secrets, simhash
from inkmeter.llm.common import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the training rows of ``docs``; documents without a determinable language go, ``lang`` becomes the prediction."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in place; no document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as the target weights ask; the budget is the least that keeps every document."""
    return mixing.mix(docs, budget_share=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs, packing.tokenizer_file, cache_words=PACKING_CACHE_WORDS)


#: Workers that have run the other stages have less room for remembered words.
PACKING_CACHE_WORDS = 60_000

STAGES = [
    ("language ID", identify_language), ("SimHash near-dedup", drop_near_duplicates), ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources), ("packing", pack_sequences),
]
#: Classifier, fingerprints and tokenizer have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")  # as the stages get it when they are run one by one
    for nth, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{nth}")
    return docs
