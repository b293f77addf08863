"""Assay tables in and out: delimited files, header cleaning, aliases, guarded CSV, reports, inventories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .digests import file_digests


def clean_name(name: str) -> str:
    text = re.sub(r"[^0-9A-Za-z]+", "_", name.strip().lower().lstrip("﻿"))
    return re.sub(r"_+", "_", text).strip("_")


def read_table(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """CSV, or TSV for .tsv and .txt; every cell a string; a byte-order mark is not part of the first header."""
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix not in ("csv", "tsv", "txt"):
        raise ValueError(f"unsupported assay table format: {path}")
    df = spark.read.csv(path, header=True, inferSchema=False, sep="," if suffix == "csv" else "\t", quote='"', escape='"',
                        multiLine=True, encoding="UTF-8")
    names = [c.lstrip("﻿") for c in df.columns]
    return apply_aliases(df.toDF(*names), {}) if clean else df.toDF(*names)


def alias_lookup(aliases: dict[str, list[str]], canonical: list[str]) -> dict[str, str]:
    out = {}
    for name in canonical:
        for alias in [name, *aliases.get(name, []), *aliases.get(clean_name(name), [])]:
            out[clean_name(alias)] = name
    return out


def apply_aliases(df: DataFrame, aliases: dict[str, list[str]], canonical: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Canonical columns from their aliases; of several, the first non-empty cell wins (or ``strict`` refuses)."""
    lookup = alias_lookup(aliases, canonical if canonical is not None else list(aliases))
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(lookup.get(clean_name(c), clean_name(c)), []).append(c)
    clash = {k: v for k, v in groups.items() if len(v) > 1}
    if strict and clash:
        raise ValueError(f"several columns map to one name: {clash}")
    quoted = lambda c: F.col(f"`{c}`")

    def cell(cols: list[str]) -> Column:
        return quoted(cols[0]) if len(cols) == 1 else F.coalesce(*[F.nullif(quoted(c), F.lit("")) for c in cols], quoted(cols[0]))

    return df.select(*[cell(cols).alias(name) for name, cols in groups.items()])


def union_tables(spark: SparkSession, paths: list[str], aliases: dict[str, list[str]] = {}, canonical: list[str] = []) -> DataFrame:
    """Rows of all files with their own columns kept and the file they came from."""
    out = None
    for path in paths:
        raw = read_table(spark, path, clean=False).withColumn("_source_file", F.lit(path))
        keep = [c for c in raw.columns if c != "_source_file"]
        part = apply_aliases(raw.select(*[F.col(f"`{c}`") for c in keep]), aliases, canonical).withColumn("_source_file", F.lit(path))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_measurements(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """``sequence activity`` lines split by tab, comma or blanks, with an offset and limit over usable lines.

    Lines are numbered file by file (by path), block by block, in reading order: a number
    within each block plus the counts of the blocks before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("at"))
    parts = F.split(F.trim("value"), r"[\t, ]+")
    rows = lines.select("file", "block", "at", F.upper(F.get(parts, F.lit(0))).alias("sequence"), F.get(parts, F.lit(1)).try_cast("double").alias("activity"))
    rows = rows.where("sequence rlike '^[ACGTN]+$' and activity is not null")
    # one row per block of a file: a window over files, and one over the blocks of each file
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"))
    files = blocks.groupBy("file").agg(F.sum("rows").alias("in_file"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("in_blocks", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(
        files.select("file", F.coalesce(F.sum("in_file").over(earlier), F.lit(0)).alias("in_files")), "file")
    inside = Window.partitionBy("file", "block").orderBy("at")
    numbered = rows.join(starts.select("file", "block", (F.col("in_blocks") + F.col("in_files")).alias("lead")), ["file", "block"]).withColumn(
        "n", F.col("lead") + F.row_number().over(inside))
    end = F.lit(True) if limit is None else F.col("n") <= offset + limit
    return numbered.where((F.col("n") > offset) & end).select("sequence", "activity", "n")


def select_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


# --- sinks ------------------------------------------------------------------------

def guard_formulas(df: DataFrame) -> DataFrame:
    """Prefix text cells a spreadsheet would run as a formula; other types are left alone."""
    out = {}
    for c, t in df.dtypes:
        if t == "string":
            cell = F.col(f"`{c}`")
            risky = cell.rlike(r"^\s*[=+\-@]") | cell.rlike(r"^[\t\r\n]")
            out[c] = F.when(risky, F.concat(F.lit("'"), cell)).otherwise(cell)
    return df.withColumns(out)


def write_table(df: DataFrame, path: str) -> None:
    guard_formulas(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, keys sorted."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    report_json(df).write.mode("overwrite").text(path)


#: Stores whose files the digest source can open; in others a file is one cell of ``binaryFile``, at most 2 GB.
STREAMED = ("file", "hdfs", "s3", "gs", "gcs")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and sha256 of every file below a folder; files are hashed in parallel where they are read."""
    if "://" not in path or path.partition("://")[0] in STREAMED:
        return file_digests(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_inventory(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Missing, size and checksum problems of a manifest against the files that exist."""
    have = found.select("path", F.col("size").alias("now_size"), F.col("sha256").alias("now_sha"), F.lit(True).alias("here"))
    why = (F.when(F.col("here").isNull(), "missing").when(F.col("size") != F.col("now_size"), "size mismatch")
           .when(F.col("sha256") != F.col("now_sha"), "checksum mismatch"))
    return manifest.join(have, "path", "left").select("path", why.alias("problem")).where("problem IS NOT NULL")


