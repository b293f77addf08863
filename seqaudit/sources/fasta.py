"""FASTA records and split manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import ordered


def parse_record(value) -> tuple[Column, Column]:
    """(header, sequence) of one record text; line breaks and blanks are removed from the sequence."""
    text = F.regexp_replace(F.col(value), r"^\s*>", "")
    lines = F.split(text, r"\r?\n", 2)
    return F.trim(lines[0]), F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s+", ""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq_index, header, sequence, length); the index follows the order in the file.

    Records are split at ``>`` by the text source, so a large file is read by many
    tasks; the record order is file block, then position inside the block.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    header, sequence = parse_record("value")
    rows = raw.where(F.trim("value") != "").select("path", "block", "at", header.alias("header"), sequence.alias("sequence"))
    lead = F.col("block").cast("double")
    numbered = ordered.row_number(rows, "n", [F.col("block"), F.col("at")], lead, ["path"])
    return numbered.select("path", (F.col("n") - 1).alias("seq_index"), "header", "sequence", F.length("sequence").alias("length"))


def check_fasta(records: DataFrame, name: str = "path") -> DataFrame:
    """Sequences, bases and sequences with a symbol other than A, C, G, T, per file."""
    return records.groupBy(name).agg(
        F.count(F.lit(1)).alias("sequences"), F.sum(F.length("sequence")).cast("bigint").alias("bases"),
        F.count_if(~F.col("sequence").rlike("^[ACGT]*$")).alias("invalid_sequences"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, seq_index long, split string").json(path)
