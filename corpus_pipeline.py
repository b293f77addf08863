"""Training-corpus pipeline: each stage works on what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of ``documents``. Nulls, empty and repeated rows, empty tables and extra columns
are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqaudit.llm import near_copies, pseudonyms, quality_table, sliced_simhash, spaced_seeds, swap_packing
from seqaudit.llm.queries import DEMO_KEY
from seqaudit.session import ensure_checkpoint_dir, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table accepts."""
    return quality_table.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Links are those of ``sliced_simhash`` (2 or fewer differing bits) and, for copies that 64 bits do not show, the
    verified ones of ``near_copies`` (5-word Jaccard 0.8 or more); groups are reached over links of both kinds.
    """
    prints = sliced_simhash.near_duplicates(docs.where("doc_id IS NOT NULL"))
    return near_copies.keep_one(docs, links=prints.select(F.col("component_id").alias("src"), F.col("id").alias("dst")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return spaced_seeds.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; ``n_chars`` follows the new text."""
    return pseudonyms.pseudonymise(docs, DEMO_KEY, length="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 4096 tokens."""
    return swap_packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: Tokens cannot be made in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
