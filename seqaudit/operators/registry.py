"""Run registry tables: upsert, flattening, listing, verification joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import non_blank, parse_float
from .campaigns import upsert


def upsert_runs(old: DataFrame, new: DataFrame, order_col: str) -> DataFrame:
    """Newest version of each run with the first creation time kept."""
    created = old.select("run_id", F.col("created_at").alias("__first"))
    merged = upsert(old, new, ["run_id"], order_col).join(created, "run_id", "left")
    return merged.withColumn("created_at", F.coalesce("__first", "created_at")).drop("__first").select(*old.columns)


def replace_children(old: DataFrame, new: DataFrame) -> DataFrame:
    """Artifacts or candidates of a re-registered run replace all its former rows."""
    return old.join(new.select("run_id").distinct(), "run_id", "left_anti").unionByName(new)


def flatten_summary(df: DataFrame, json_col: str, workflow: str) -> DataFrame:
    """Run row from a summary JSON; the primary metric sits in a different place per workflow."""
    at = lambda p: F.get_json_object(json_col, p)
    flow = F.col(workflow)
    metric = (F.when(flow == "prediction", at("$.prediction_audit.test_metrics.primary_metric"))
              .when(flow == "simulation", at("$.report.primary_metric")).otherwise(at("$.report.task_head_primary_metric")))
    return df.select(
        "*", at("$.project").alias("project"), metric.cast("double").alias("primary_metric"),
        at("$.split_diagnostics.split_sizes.test").cast("bigint").alias("test_rows"),
        F.coalesce(at("$.valid_prediction_rows"), at("$.audit.accepted_rows")).cast("bigint").alias("accepted_rows"),
        F.coalesce(at("$.execution_manifest.status"), F.lit("completed")).alias("status"))


def list_runs(runs: DataFrame, limit: int, tie: str = "run_id") -> DataFrame:
    return runs.orderBy(F.desc("updated_at"), tie).limit(limit)


def latest_candidates(runs: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates of the latest runs, by run recency and rank."""
    joined = runs.select("run_id", "updated_at").join(candidates, "run_id")
    return joined.orderBy(F.desc("updated_at"), "run_id", "rank").limit(limit)


def reindex(spark: SparkSession, folder: str, names: str = "*summary*.json") -> DataFrame:
    """One row per summary file found below a folder, unreadable files marked."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", names).text(folder)
    valid = F.try_parse_json("value").isNotNull() if hasattr(F, "try_parse_json") else F.lit(True)
    return raw.select(F.col("_metadata.file_path").alias("path"), "value", valid.alias("readable"))


def collapse_views(runs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First run per key in the given order; NULLs in the key are equal to each other."""
    picked = runs.groupBy(*key).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "run_id")).alias("m"))
    return picked.select(F.col("m.run_id").alias("run_id"))


def prediction_output_check(locked: DataFrame, output: DataFrame, key: str, prediction: str) -> DataFrame:
    """Missing, extra, duplicate and blank ids and non-numeric predictions of a model's output."""
    a = locked.select(F.col(key).cast("string").alias("k")).distinct().withColumn("want", F.lit(True))
    b = output.groupBy(F.trim(F.col(key).cast("string")).alias("k")).agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(parse_float(prediction).isNull()).alias("bad"))
    both = a.join(b, "k", "full_outer")
    why = F.array_compact(F.array(
        F.when(~non_blank("k"), "blank identifier"),
        F.when(F.col("copies").isNull(), "missing identifier"),
        F.when(F.col("want").isNull() & non_blank("k"), "unexpected identifier"),
        F.when(F.col("copies") > 1, "duplicate identifier"),
        F.when(F.col("bad") > 0, "non-numeric prediction")))
    return both.select("k", F.explode(why).alias("problem"))


def lookup_explanations(ranked: DataFrame, explanations: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """Reason of each ranked row from the first key that finds an explanation (rank, display id, hash)."""
    out = ranked
    found = []
    for k in keys:
        side = explanations.where(F.col(k).isNotNull()).groupBy(run, k).agg(F.min("ranking_reason").alias(f"__{k}"))
        out = out.join(side, [run, k], "left")
        found.append(F.col(f"__{k}"))
    return out.withColumn("ranking_reason", F.coalesce(*found)).drop(*[f"__{k}" for k in keys])


def enrich_aligned(main: DataFrame, companion: DataFrame, row: str, check: str, columns: list[str]) -> DataFrame:
    """Add companion columns only when every row has the same ``check`` value on both sides."""
    pair = main.select(row, F.col(check).alias("a")).join(companion.select(row, F.col(check).alias("b")), row, "full_outer")
    ok = pair.agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(False)).alias("ok")).first()["ok"]
    return main.join(companion.select(row, *columns), row, "left") if ok else main
