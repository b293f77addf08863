"""Registered queries of the training-data operators; each covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import read
from . import (chat_windows, hard_negatives, importance_resampling, license_rules, main_text, oracles, pseudonyms, pu_quality, quality_table,
               sliced_simhash, spaced_seeds, swap_packing, token_counts, url_vocabulary)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.SQL)

#: Key of the registered query; a deployment passes its own secret.
DEMO_KEY = b"pseudonym key of the registered query"


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    found = license_rules.licences(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"),
                        F.array_join("licences", ",").alias("licences"), "family")


@_register
def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_register
def op4_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_vocabulary.judge(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@_register
def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one made of control strings, read back from their windows."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_windows.digests(chat_windows.windows(rows))


@_register
def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values that were."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, DEMO_KEY, counted="n_replaced")


@_register
def op6_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack(read(spark, sf_dir, "documents"))


@_register
def op7_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents: the longest overlap with each benchmark item."""
    return spaced_seeds.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_table.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


@_register
def op9_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = sliced_simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_register
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.main_text(pages, main_text.learn(pages))


@_register
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's texts, and the ranks of the quarter that is drawn."""
    drawn = importance_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@_register
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are a hundredth of the ids; a seventh of the labels is shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)
