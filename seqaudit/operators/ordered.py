"""Order-dependent columns (ranks, running sums, row numbers) without one big task.

A window without a partition key, or with one hot key, would sort everything in one
task. Here rows are first dealt to range buckets by the whole sort order, with a row mark
as the last tie-break, so a value held by a third of all rows is split like any other;
each bucket is a window partition of its own and the totals of the buckets before it are
added. Up to ``ROWS_PER_TASK`` rows there is a single bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import parallelism, settle

ROWS_PER_TASK = 1_000_000


def with_bucket(df: DataFrame, order: list[Column], rows_per_task: int | None = None) -> tuple[DataFrame, int]:
    """Add ``__tie``, a row mark that ends the order, and ``__bucket``, a range of (order, mark)."""
    limit = rows_per_task or ROWS_PER_TASK
    # written once: what the rows are derived from is read a single time, and marks and ranges stay as they are
    marked = settle(df.withColumn("__tie", F.monotonically_increasing_id()))
    wanted = math.ceil(marked.count() / limit)
    if wanted <= 1:
        return marked.withColumn("__bucket", F.lit(0)), 1
    ranged = marked.repartitionByRange(wanted, *order, F.col("__tie"))
    return settle(ranged.withColumn("__bucket", F.spark_partition_id())), wanted


def running_sums(df: DataFrame, values: dict[str, Column], order: list[Column], lead: Column | None = None,
                 group: list[str] = [], rows_per_task: int | None = None) -> DataFrame:
    """Inclusive running sums of several values in ``order`` within ``group``.

    ``lead`` is accepted for callers that know a leading number; the order alone decides.
    """
    df = df.withColumns({f"__v_{n}": v for n, v in values.items()})
    df, buckets = with_bucket(df, order, rows_per_task)
    if buckets > 1:
        keys = [*group, "__bucket"]
        totals = df.groupBy(*keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
        before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, *[
            F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in values])
        df = df.join(offsets, keys)
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n in values:
        total = F.sum(f"__v_{n}").over(inside)
        out[n] = total + F.col(f"__before_{n}") if buckets > 1 else total
    return df.withColumns(out).drop("__bucket", "__tie", *[f"__{x}_{n}" for n in values for x in ("v", "before")])


def running_sum(df: DataFrame, name: str, value: Column, order: list[Column], lead: Column | None = None,
                group: list[str] = [], rows_per_task: int | None = None) -> DataFrame:
    return running_sums(df, {name: value}, order, lead, group, rows_per_task)


def row_number(df: DataFrame, name: str, order: list[Column], lead: Column | None = None, group: list[str] = [],
               rows_per_task: int | None = None) -> DataFrame:
    return running_sums(df, {name: F.lit(1).cast("bigint")}, order, lead, group, rows_per_task)


def average_rank(df: DataFrame, name: str, value: str, group: list[str] = [],
                 rows_per_task: int | None = None) -> DataFrame:
    """1-based rank, ties share their mean rank.

    Ties are counted before anything is ordered, so a value held by a third of all
    rows is one row in the ordering.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_sum(counts, "__through", F.col("__c"), [F.col(value)], F.col(value).cast("double"), group,
                         rows_per_task)
    ranks = placed.select(*group, value, (F.col("__through") - (F.col("__c") - 1) / 2).alias(name))
    return df.join(ranks, [*group, value])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str] = [],
              rows_per_task: int | None = None) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours; nulls are left out.

    Equal values are counted first; the counts are summed in order, and each quantile is
    read from the one or two values its position falls on.
    """
    counts = settle(df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__x")).agg(
        F.count(F.lit(1)).alias("__c")))
    placed = running_sum(counts, "__upto", F.col("__c"), [F.col("__x")], None, group, rows_per_task)
    totals = counts.groupBy(*group).agg(F.sum("__c").alias("__n"))
    joined = placed.join(totals, group) if group else placed.join(F.broadcast(totals))
    cells = {}
    for name, share in shares.items():
        at = F.lit(share) * (F.col("__n") - 1)  # position from 0
        holds = lambda p: (F.col("__upto") - F.col("__c") <= p) & (p < F.col("__upto"))
        part = at - F.floor(at)
        low, high = (F.max(F.when(holds(p), F.col("__x"))) for p in (F.floor(at), F.ceil(at)))
        cells |= {f"__lo_{name}": low, f"__hi_{name}": high, f"__part_{name}": F.max(part)}
    found = joined.groupBy(*group).agg(*[c.alias(n) for n, c in cells.items()])
    return found.select(*group, *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")).alias(n) for n in shares])


def top_k(df: DataFrame, k: int, order: list[Column], group: list[str], salt: Column, shards: int | None = None) -> DataFrame:
    """First k rows of each group: k per shard first, then k of those, so no group is one task."""
    shards = shards or max(64, parallelism(df.sparkSession))
    shard = F.pmod(F.xxhash64(salt), F.lit(shards))
    local = Window.partitionBy(*group, "__shard").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("__shard", shard)
        .withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .drop("__shard")
    )
