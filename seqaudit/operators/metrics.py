"""Prediction metrics as aggregations, per group and with row weights.

Weights make a bootstrap replicate the same computation as the full table: a cluster
drawn twice is a row weight of two. Rank-based metrics aggregate equal scores first and
order only the distinct ones.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import col
from ..session import settle
from . import ordered

FLAT = 1e-12


def _pearson(sw, sx, sy, sxx, syy, sxy, flat: float = FLAT) -> Column:
    vx, vy = sxx / sw - (sx / sw) * (sx / sw), syy / sw - (sy / sw) * (sy / sw)
    dx, dy = F.sqrt(F.greatest(vx, F.lit(0.0))), F.sqrt(F.greatest(vy, F.lit(0.0)))
    return F.when((sw > 1) & (dx >= flat) & (dy >= flat), (sxy / sw - (sx / sw) * (sy / sw)) / (dx * dy))


def pearson(x: str, y: str, flat: float = FLAT) -> Column:
    """Correlation aggregate that is NULL, not an error, for a constant column."""
    dx, dy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(F.lit(1)) > 1) & (dx >= flat) & (dy >= flat), F.covar_pop(x, y) / (dx * dy))


def moments(target: str, prediction: str, keys: list[str], df: DataFrame) -> DataFrame:
    """Additive statistics from which RMSE, MAE, R2 and Pearson follow."""
    t, p = col(target).cast("double"), col(prediction).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(t).alias("t"), F.sum(p).alias("p"), F.sum(t * t).alias("tt"),
        F.sum(p * p).alias("pp"), F.sum(t * p).alias("tp"), F.sum((p - t) * (p - t)).alias("se"),
        F.sum(F.abs(p - t)).alias("ae"))


def from_moments(prefix: str = "") -> dict[str, Column]:
    c = lambda n: F.col(prefix + n)
    total = c("tt") - c("t") * c("t") / c("w")
    return {
        "rmse": F.sqrt(c("se") / c("w")),
        "mae": c("ae") / c("w"),
        "r2": F.when(total > FLAT, 1 - c("se") / total),
        "pearson": _pearson(c("w"), c("t"), c("p"), c("tt"), c("pp"), c("tp")),
        "num_rows": c("w").cast("bigint"),
    }


def regression_metrics(df: DataFrame, target: str, prediction: str, keys: list[str] = []) -> DataFrame:
    """RMSE, MAE, R2 and Pearson per group; two-pass variances keep the digits of large means."""
    t, p = col(target), col(prediction)
    var = F.var_pop(t) * F.count(t)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"), F.avg(F.abs(p - t)).alias("mae"),
        F.when(var > FLAT, 1 - F.sum((p - t) * (p - t)) / F.greatest(var, F.lit(FLAT))).alias("r2"),
        pearson(target, prediction).alias("pearson"), F.count(F.lit(1)).alias("num_rows"))


def weighted_ranks(df: DataFrame, value: str, weight: Column, keys: list[str], name: str) -> DataFrame:
    """Average rank of each value when a row of weight w stands for w equal rows."""
    held = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    placed = ordered.running_sum(held, "__through", F.col("__w"), [F.col(value)], F.col(value).cast("double"), keys)
    ranks = placed.select(*keys, value, (F.col("__through") - (F.col("__w") - 1) / 2).alias(name))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, x: str, y: str, keys: list[str] = [], weight: Column | None = None, name: str = "spearman") -> DataFrame:
    rows = df.select(*keys, col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), (F.lit(1.0) if weight is None else weight).alias("w"))
    rows = settle(rows) if weight is None else rows
    ranked = weighted_ranks(weighted_ranks(rows, "x", F.col("w"), keys, "rx"), "y", F.col("w"), keys, "ry")
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("sw"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"),
        F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    value = _pearson(*[F.col(c) for c in ("sw", "sa", "sb", "saa", "sbb", "sab")])
    return sums.select(*keys, value.alias(name))


def auroc(df: DataFrame, label: str, score: str, keys: list[str] = [], weight: Column | None = None) -> DataFrame:
    """Probability that a positive outranks a negative, ties one half; NULL with one class."""
    weight = F.lit(1.0) if weight is None else weight
    held = df.groupBy(*keys, score).agg(
        F.sum(F.when(col(label) == 1, weight).otherwise(0.0)).alias("pos"),
        F.sum(F.when(col(label) == 1, 0.0).otherwise(weight)).alias("neg"))
    placed = ordered.running_sum(held, "through", F.col("neg"), [F.col(score)], F.col(score).cast("double"), keys)
    sums = placed.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("through") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0),
                                     F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auroc"))


def score_order(df: DataFrame, label: str, score: str, tie: str, keys: list[str] = []) -> DataFrame:
    """Rows by descending score (ties by id) with position, hits and misses so far."""
    return ordered.running_sums(
        df, {"position": F.lit(1).cast("bigint"), "hits": col(label).cast("bigint"), "misses": (1 - col(label)).cast("bigint")},
        [F.desc(score), F.col(tie)], -F.col(score).cast("double"), keys)


def average_precision(df: DataFrame, label: str, score: str, tie: str, keys: list[str] = []) -> DataFrame:
    at = score_order(df, label, score, tie, keys).where(col(label) == 1)
    return at.groupBy(*keys).agg(F.avg(F.col("hits") / F.col("position")).alias("average_precision"))


def classification_metrics(df: DataFrame, label: str, score: str, keys: list[str] = []) -> DataFrame:
    """Accuracy, balanced accuracy, F1, precision and recall at 0.5, Brier and log loss."""
    y, s = col(label), col(score)
    hit = s >= 0.5
    clip = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), s))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_rows"), F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"),
        F.avg((clip - y) * (clip - y)).alias("brier"),
        (-F.avg(y * F.log(clip) + (1 - y) * F.log(1 - clip))).alias("log_loss"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(F.lit(0.0))
    parts = F.array_compact(F.array(F.when(tp + fn > 0, recall), F.when(tn + fp > 0, share(tn, tn + fp))))
    both = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(parts), F.lit(0)))
    status = F.when((tp + fn > 0) & (tn + fp > 0), "ok").otherwise("not_evaluable_single_class")
    return out.select(*keys, "num_rows", ((tp + tn) / F.col("num_rows")).alias("accuracy"), both.alias("balanced_accuracy"),
                      f1.alias("f1"), precision.alias("precision"), recall.alias("recall"), "brier", "log_loss",
                      status.alias("status"))


def pairwise_accuracy(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Share of pairs with different truth that the prediction orders the same way.

    Two truths differ at exactly one highest bit of their dense ranks. Each row is
    listed once per bit; rows that agree above a bit meet in one group, and a running
    count of the lower half in prediction order counts the pairs without forming them.
    """
    rows = settle(df.select(col(target).cast("double").alias("t"), col(prediction).cast("double").alias("p")))
    held = rows.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    dense = ordered.row_number(held, "r", [F.col("t")], F.col("t"))
    stats = held.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("d"))
    d = stats.first()["d"]
    bits = max(1, math.ceil(math.log2(max(d, 2)))) + 1
    coded = rows.join(dense.select("t", (F.col("r") - 1).alias("r")), "t")
    levels = coded.select("p", "r", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    shift = lambda x, n: F.call_function("shiftright", x, n)
    sides = levels.select("bit", shift(F.col("r"), F.col("bit") + 1).alias("node"),
                          shift(F.col("r"), F.col("bit")).bitwiseAND(F.lit(1).cast("bigint")).alias("side"), "p")
    counts = sides.groupBy("bit", "node", "p").agg(
        F.count_if(F.col("side") == 0).alias("low"), F.count_if(F.col("side") == 1).alias("high"))
    placed = ordered.running_sum(counts, "below", F.col("low"), [F.col("p")], F.col("p"), ["bit", "node"])
    right = placed.agg(F.sum(F.col("high") * (F.col("below") - F.col("low"))).alias("right"))
    total = (F.col("n") * F.col("n") - F.col("same")) / 2
    return stats.join(right).select(
        F.when(total > 0, F.col("right") / F.nullif(total, F.lit(0.0))).alias("pairwise_accuracy"), total.cast("bigint").alias("pairs"))


def primary_metric(task: str, metrics: dict[str, Column]) -> tuple[Column, Column]:
    """(value, name): the task's first metric, with its fallback when that one is NULL."""
    order = {"classification": ["auroc", "balanced_accuracy"], "ranking": ["spearman", "pairwise_accuracy"],
             "regression": ["r2"]}[task]
    known = [n for n in order if n in metrics]
    value = F.coalesce(*[metrics[n] for n in known])
    name = reduce(lambda acc, n: F.when(metrics[n].isNotNull(), n).otherwise(acc), reversed(known[:-1]), F.lit(known[-1]))
    return value, name


def uncertainty_audit(df: DataFrame, target: str, prediction: str, uncertainty: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(summary, bins): how far a declared uncertainty follows the absolute error."""
    rows = settle(df.where(F.col(uncertainty) >= 0).select(
        col(tie).alias("tie"), col(uncertainty).alias("u"), F.abs(col(prediction) - col(target)).alias("e")))
    one = rows.agg(
        F.count(F.lit(1)).alias("num_rows"), pearson("u", "e").alias("uncertainty_abs_error_pearson"),
        F.avg("u").alias("mean_uncertainty"), F.avg("e").alias("mean_abs_error"),
        F.avg(F.abs(F.col("u") - F.col("e"))).alias("mean_absolute_calibration_gap"))
    summary = one.join(spearman(rows, "u", "e", name="uncertainty_abs_error_spearman"))
    summary = summary.withColumn("status", F.when(F.col("num_rows") >= 3, "ok").otherwise("skipped"))
    return summary, near_equal_bins(rows, "u", "tie", 5, ["u", "e"])


def near_equal_bins(rows: DataFrame, by: str, tie: str, bins: int, means: list[str]) -> DataFrame:
    """Bins of near-equal size in value order; the first ``n mod bins`` bins hold one row more."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    numbered = ordered.row_number(rows, "pos", [F.col(by), F.col(tie)], F.col(by).cast("double")).join(F.broadcast(n))
    width = F.floor(F.col("n") / bins)
    extra = F.col("n") % bins
    at = F.col("pos") - 1
    wide = extra * (width + 1)
    bin_ = F.when(at < wide, F.floor(at / (width + 1))).otherwise(extra + F.floor((at - wide) / F.greatest(width, F.lit(1)))) + 1
    return numbered.groupBy(bin_.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(m).alias(f"mean_{m}") for m in means])


def ranking_audit(df: DataFrame, target: str, prediction: str, tie: str, top_k: int, minimize: bool = False) -> DataFrame:
    """Top-k mean, enrichment and the predicted rank of the truly best row."""
    sign = 1 if minimize else -1
    rows = settle(df.select(col(target).alias("t"), col(prediction).alias("p"), col(tie).alias("tie")))
    top = rows.orderBy(sign * F.col("p"), "tie").limit(top_k)
    head = top.agg(F.avg("t").alias("top_k_target_mean"), F.count(F.lit(1)).alias("top_k"))
    best = rows.agg(F.count(F.lit(1)).alias("num_rows"), F.avg("t").alias("overall_target_mean"),
                    F.min(F.struct((sign * F.col("t")).alias("o"), "tie", "p")).alias("best"))
    ahead = rows.join(F.broadcast(best.select("best"))).where(
        (sign * F.col("p") < sign * F.col("best.p")) | ((F.col("p") == F.col("best.p")) & (F.col("tie") < F.col("best.tie"))))
    rank = ahead.agg((F.count(F.lit(1)) + 1).alias("best_true_item_rank_by_prediction"))
    out = best.drop("best").join(head).join(rank).join(spearman(rows, "t", "p"))
    mean = F.col("overall_target_mean")
    return out.withColumn("top_k_enrichment", F.when(F.abs(mean) >= FLAT, F.col("top_k_target_mean") / F.nullif(mean, F.lit(0.0))))


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC and PR points, one per distinct score from high to low."""
    held = df.groupBy(col(score).alias("threshold")).agg(
        F.sum(col(label).cast("bigint")).alias("pos"), F.sum(1 - col(label).cast("bigint")).alias("neg"))
    placed = ordered.running_sums(held, {"tp": F.col("pos"), "fp": F.col("neg")}, [F.desc("threshold")],
                                  -F.col("threshold").cast("double"))
    totals = held.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0)))
    return placed.join(F.broadcast(totals)).select(
        "threshold", rate("tp", "P").alias("tpr"), rate("fp", "N").alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def top_overlap(df: DataFrame, target: str, prediction: str, tie: str, minimize: bool = False) -> DataFrame:
    """Share of the true top k that the predicted top k holds, for every k.

    A row is in both top lists exactly from k = the larger of its two ranks on.
    """
    sign = 1.0 if minimize else -1.0
    rows = df.select((sign * col(target)).alias("t"), (sign * col(prediction)).alias("p"), col(tie).alias("tie"))
    a = ordered.row_number(rows, "a", [F.col("t"), F.col("tie")], F.col("t"))
    b = ordered.row_number(a, "b", [F.col("p"), F.col("tie")], F.col("p"))
    first = b.groupBy(F.greatest("a", "b").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    every = b.select(F.col("a").alias("k")).join(first, "k", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    placed = ordered.running_sum(every, "both", F.col("c"), [F.col("k")], F.col("k").cast("double"))
    return placed.select("k", (F.col("both") / F.col("k")).alias("overlap"))


def residual_histogram(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Residual counts in max(6, min(20, 2*sqrt(n))) equal-width bins."""
    rows = df.select((col(prediction) - col(target)).alias("r"))
    s = rows.agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("bins", F.greatest(F.lit(6), F.least(F.lit(20), F.floor(2 * F.sqrt("n")).cast("int"))))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    at = F.when(width > 0, F.least(F.floor((F.col("r") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.col("bins") - 1)).otherwise(F.lit(0))
    return rows.join(F.broadcast(s)).groupBy(at.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.col("lo") + width * at).alias("left"))


def slice_summary(df: DataFrame, columns: list[str], target: str, prediction: str, max_levels: int = 50) -> DataFrame:
    """Errors per (column, level) in one grouping-sets pass; columns with too many levels are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("level")) for c in columns])
    e = F.col("e")
    rows = df.select((col(prediction) - col(target)).alias("e"), F.explode(cells).alias("s"))
    held = rows.groupBy("s.column", "s.level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    few = held.groupBy("column").agg(F.count(F.lit(1)).alias("levels")).where(F.col("levels") <= max_levels)
    return held.join(few.select("column"), "column").withColumn("low_n", F.col("n") < 5)


def replicate_noise(df: DataFrame, id_col: str, value_col: str, keys: list[str] = []) -> DataFrame:
    """Unweighted mean within-id variance against the total variance."""
    value = col(value_col).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value) & F.col(id_col).isNotNull())
    per = rows.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("c"), F.var_pop(value).alias("v"))
    within = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_candidates"), F.count_if(F.col("c") > 1).alias("replicated_candidates"),
        F.avg(F.when(F.col("c") > 1, F.col("v"))).alias("within_candidate_variance"))
    total = rows.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 1, F.var_pop(value)).alias("total_variance"))
    out = within.join(total, keys) if keys else within.join(total)
    ratio = 1 - F.col("within_candidate_variance") / F.nullif(F.col("total_variance"), F.lit(0.0))
    return out.withColumn("approximate_reliability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def sample_size(effect, alpha, power) -> Column:
    """Rows for a two-sided effect; NULL outside the valid ranges."""
    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return p.map(NormalDist().inv_cdf)

    effect, alpha, power = col(effect), col(alpha), col(power)
    valid = (effect > 0) & (alpha > 0) & (alpha < 1) & (power > 0) & (power < 1)
    z = quantile(F.when(valid, 1 - alpha / 2).otherwise(0.5)) + quantile(F.when(valid, power).otherwise(0.5))
    n = F.ceil((z / effect) * (z / effect))
    return F.when(valid, F.greatest(F.lit(2), n).cast("bigint"))
