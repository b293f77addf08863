"""Leakage-safe split: whole components go to test, then validation, then training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seq
from ..functions.values import is_missing
from ..functions.wording import SAYS
from ..session import cut
from . import ordered
from .similarity import leakage_components


def fingerprints(df: DataFrame, comps: DataFrame, id_col: str, sequence_col: str, group_cols: list[str]) -> DataFrame:
    """(component, size, fingerprint): digest of the sorted member texts of each cluster.

    See ``list_digest`` for the definition, which does not depend on the cluster's size.
    """
    parts = [F.when(~is_missing(c), F.concat(F.lit(f"{c}="), F.trim(F.col(c).cast("string")))) for c in group_cols]
    member = F.concat_ws("|", seq.sequence_hash(sequence_col), *parts)
    rows = df.select(F.col(id_col).alias("id"), member.alias("m")).join(comps, "id")
    return list_digest(rows, "m", ["component"], "fingerprint", "size")


#: Leading characters of a value that decide its shard; of a hash, 65,536 shards.
SHARD_PREFIX = 4


def list_digest(rows: DataFrame, value: str, keys: list[str], name: str, size: str) -> DataFrame:
    """Digest of the values of each key with their numbers, and how many rows there are.

    Equal values become one line ``value x copies``. The lines of each value prefix, in
    order, are one sha256; the digests of the prefixes, in order, are digested again. Copies
    are counted before anything is listed, and no buffer holds more than one prefix.
    """
    lines = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__line", F.concat(F.col(value), F.lit(" x"), F.col("__n").cast("string")))
    shards = lines.groupBy(*keys, F.substring(value, 1, SHARD_PREFIX).alias("__shard")).agg(
        F.sum("__n").alias("__n"), F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), "\n"), 256).alias("d"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("__shard", "d"))), lambda s: s["d"])
    return shards.groupBy(*keys).agg(F.sum("__n").alias(size), F.sha2(F.array_join(digests, "\n"), 256).alias(name))


def desired(n: int, fraction: float, clusters: int) -> int:
    want = int(round(n * fraction))
    return max(1, want) if clusters >= 3 and fraction > 0 else want


def assign_clusters(clusters: DataFrame, rows: int, count: int, val_fraction: float, test_fraction: float,
                    seed: int) -> DataFrame:
    """Add ``split`` to (component, size, fingerprint).

    Clusters are taken from the smallest end; a cluster goes to test while the rows
    before it are fewer than wanted, then to validation, and the last one always stays
    in training. That is a running sum over clusters in one fixed order.
    """
    want_test = desired(rows, test_fraction, count)
    want_val = desired(rows, val_fraction, count)
    keyed = clusters.withColumn("draw", F.sha2(F.concat_ws(":", F.lit(str(int(seed))), "fingerprint"), 256))
    # size first, then the digest descending: one double that never decreases in that order
    fraction = F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") / float(16**12)
    order = [F.col("size"), F.desc("draw"), F.col("component")]
    lead = F.col("size") + (1 - fraction)
    placed = ordered.running_sum(keyed, "through", F.col("size"), order, lead)
    placed = cut(placed.withColumn("before", F.col("through") - F.col("size")))
    last = F.col("through") == rows
    test = (F.lit(want_test) > 0) & (F.col("before") < want_test) & ~last
    filled = placed.where(test).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    val = (F.lit(want_val) > 0) & (F.col("before") - filled < want_val) & ~last
    return placed.withColumn("split", F.when(test, "test").when(val, "val").otherwise("train"))


def assign_grouped(clusters: DataFrame, keys: list[str], val_fraction: float, test_fraction: float, seed: int) -> DataFrame:
    """``assign_clusters`` for every group of ``keys`` at once, by the same order and the same wants."""
    totals = clusters.groupBy(*keys).agg(F.sum("size").alias("__n"), F.count(F.lit(1)).alias("__c"))
    want = lambda share: F.when((F.col("__c") >= 3) & F.lit(share > 0), F.greatest(F.lit(1), F.bround(F.col("__n") * share))).otherwise(
        F.bround(F.col("__n") * share))
    keyed = clusters.withColumn("draw", F.sha2(F.concat_ws(":", F.lit(str(int(seed))), "fingerprint"), 256))
    order = [F.col("size"), F.desc("draw"), F.col("component")]
    placed = ordered.running_sum(keyed, "through", F.col("size"), order, group=keys)
    placed = cut(placed.join(F.broadcast(totals), keys).withColumn("before", F.col("through") - F.col("size")))
    last = F.col("through") == F.col("__n")
    test = (want(test_fraction) > 0) & (F.col("before") < want(test_fraction)) & ~last
    filled = placed.groupBy(*keys).agg(F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)).alias("__filled"))
    placed = placed.join(F.broadcast(filled), keys)
    val = (want(val_fraction) > 0) & (F.col("before") - F.col("__filled") < want(val_fraction)) & ~last
    return placed.withColumn("split", F.when(test, "test").when(val, "val").otherwise("train")).drop("__n", "__c", "__filled")


def leakage_safe_split(df: DataFrame, id_col: str, sequence_col: str, group_cols: list[str] = [],
                       val_fraction: float = 0.15, test_fraction: float = 0.15, threshold: float = 0.9,
                       k: int = 8, policy: str = "canonical_kmer_jaccard", seed: int = 13,
                       hot: int | None = None) -> DataFrame:
    """(id, component, leakage_cluster, split) for every row."""
    if not 0 <= val_fraction < 1 or not 0 <= test_fraction < 1 or val_fraction + test_fraction >= 1:
        raise ValueError("validation and test fractions must be in [0, 1) and leave training rows")
    if not 0 <= threshold <= 1:
        raise ValueError("the similarity threshold must be in [0, 1]")
    if k <= 0:
        raise ValueError("k must be positive")
    absent = [c for c in group_cols if c not in df.columns]
    if absent:
        raise ValueError(f"group columns are absent: {absent}")
    comps = cut(leakage_components(df, id_col, sequence_col, group_cols, policy, threshold, k, hot))
    clusters = cut(fingerprints(df, comps, id_col, sequence_col, group_cols))
    totals = clusters.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c")).first()
    placed = assign_clusters(clusters, totals["n"] or 0, totals["c"], val_fraction, test_fraction, seed)
    return comps.join(
        placed.select("component", F.substring("fingerprint", 1, 16).alias("leakage_cluster"), "split"), "component"
    ).select("id", "component", "leakage_cluster", "split")


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("leakage_cluster").alias("clusters"))


def split_warnings(sizes: DataFrame, val_fraction: float = 0.15, test_fraction: float = 0.15) -> DataFrame:
    """Warnings of a split from its (split, rows, clusters) table."""
    held = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("rows"))), F.lit(0))
    one = sizes.agg(F.coalesce(F.sum("clusters"), F.lit(0)).alias("clusters"), held("val").alias("val"),
                    held("test").alias("test"))
    empty = F.array_compact(F.array(
        F.when((F.col("val") == 0) & F.lit(val_fraction > 0), "validation"),
        F.when((F.col("test") == 0) & F.lit(test_fraction > 0), "test")))
    texts = F.array_compact(F.array(
        F.when(F.col("clusters") < 3, SAYS["do_not_trust_fewer_than"]),
        F.when(F.size(empty) > 0, F.concat(
            F.lit(SAYS["do_not_trust_requested_leakage"]), F.array_join(empty, " and "),
            F.lit(SAYS["split_is_empty_collect_more"])))))
    return one.select(F.explode(texts).alias("warning"))


def membership_digest(split: DataFrame, hash_col: str) -> DataFrame:
    """Digest of the sorted test-set sequence hashes."""
    rows = split.where("split = 'test'").select(F.lit("test").alias("split"), hash_col)
    return list_digest(rows, hash_col, ["split"], "test_membership_sha256", "test_rows")


def hash_split(c) -> Column:
    """First 8 hex digits modulo 10: 0 test, 1 validation, else train."""
    bucket = F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint") % 10
    return F.when(bucket == 0, "test").when(bucket == 1, "validation").otherwise("train")



def homology_benchmark(df: DataFrame, id_col: str, sequence_col: str, evaluate, threshold: float = 0.70,
                       val_fraction: float = 0.10, test_fraction: float = 0.15, seed: int = 13):
    """Split at a loose threshold and hand (train, val, test) tables to a caller's evaluation."""
    parts = leakage_safe_split(df, id_col, sequence_col, val_fraction=val_fraction, test_fraction=test_fraction,
                               threshold=threshold, seed=seed)
    rows = cut(df.join(parts.select(F.col("id").alias(id_col), "split", "leakage_cluster"), id_col))
    return evaluate(*[rows.where(F.col("split") == s) for s in ("train", "val", "test")])
