"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``:
rejected documents and all but one of each near-duplicate group go, secrets are replaced in the texts, the mix drops
and repeats documents, and the last stage encodes what is left.

Defined results: documents with a null, empty or short text are rejected by the first stage; a null id, lang or source is a value like any other
(null is a source of its own); of repeated rows and other copies one is kept, the first of those of the least id, and the mix may
repeat it; texts of any length are processed whole; an empty table, or one of which no document is kept, gives an empty result of
the same columns; further columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowforge.llm import bpe, mixing, near_duplicates, quality_rules, secrets
from rowforge.sources.files import Store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.distinct_documents(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicate), ("secret_scans", secret), ("mixing", mix), ("bpe", tokens)]

#: Several stages (compression ratios, MinHash, byte-pair merges) are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again; what no later stage reads is deleted."""
    store = Store(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := store.scratch(name))
        if before:
            store.delete(before.rpartition("/")[0])
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
