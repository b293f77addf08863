"""Simple baselines and linear ensembles.

Linear models need only X'X and X'y. Each task sums them over its own rows and returns
one small matrix; the matrices are added by Spark and solved on the driver, whose share
does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seq
from ..functions.hashrand import poisson, uniform
from ..functions.values import MISSING, UNKNOWN, col
from ..session import cut

Featurize = Callable[[pd.DataFrame], np.ndarray]


# --- features ---------------------------------------------------------------------

def gc_length_matrix(sequence_col: str) -> Featurize:
    def build(pdf: pd.DataFrame) -> np.ndarray:
        # no ``.str``: that accessor and its column hold each other, so whole batches would pile up in the worker
        texts = pdf[sequence_col].tolist()
        numbers = lambda f: np.array([f(t) if isinstance(t, str) else np.nan for t in texts], float)
        n, gc = numbers(len), numbers(lambda t: t.count("G") + t.count("C"))
        return np.column_stack([np.log1p(n), gc / np.maximum(n, 1)])

    return build


def kmer_features(sequence_col: str, k: int) -> Featurize:
    """Length and GC followed by the k-mer frequencies."""
    head = gc_length_matrix(sequence_col)
    return lambda pdf: np.column_stack([head(pdf), seq.kmer_matrix(pdf[sequence_col], k)])


def array_features(array_col: str) -> Featurize:
    return lambda pdf: np.stack(pdf[array_col].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 0))


# --- additive normal equations ----------------------------------------------------

def gram(df: DataFrame, columns: list[str], build: Featurize, target: str, weights: str | None = None) -> list[np.ndarray]:
    """Per ensemble member the matrix [1 X y]'W[1 X y]; one member of weight 1 without ``weights``."""
    keep = list(dict.fromkeys([*columns, target] + ([weights] if weights else [])))

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = build(pdf)
            z = np.column_stack([np.ones(len(pdf)), x, pdf[target].to_numpy(dtype=float)])
            w = np.stack(pdf[weights].to_numpy()).astype(float) if weights else np.ones((len(pdf), 1))
            for m in range(w.shape[1]):
                part = z.T @ (z * w[:, m : m + 1])
                total[m] = total[m] + part if m in total else part
        yield pd.DataFrame({"member": list(total), "cells": [t.ravel() for t in total.values()]})

    parts = df.select(*keep).mapInPandas(partial, "member int, cells array<double>")
    cells = parts.select("member", F.posexplode("cells").alias("at", "v")).groupBy("member", "at").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("member").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c")).collect()
    out = []
    for r in sorted(rows, key=lambda r: r["member"]):
        flat = np.array([c["v"] for c in r["c"]])
        side = int(round(np.sqrt(len(flat))))
        out.append(flat.reshape(side, side))
    return out


def ridge_all(g: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Coefficients with the penalty on every term, the intercept included."""
    a = g[:-1, :-1]
    return np.linalg.pinv(a + np.eye(len(a)) * penalty) @ g[:-1, -1]


def ridge_scaled(g: np.ndarray, alpha: float = 1.0, scale: bool = True) -> np.ndarray:
    """Ridge on unit-variance features with a free intercept, returned for the raw features."""
    n = g[0, 0]
    mean = g[0, 1:-1] / n
    y = g[0, -1] / n
    cov = g[1:-1, 1:-1] - n * np.outer(mean, mean)
    xy = g[1:-1, -1] - n * mean * y
    std = np.sqrt(np.maximum(np.diag(cov), 0) / n)
    std = np.where(std > 1e-12, std, 1.0) if scale else np.ones(len(mean))
    w = np.linalg.solve(cov / np.outer(std, std) + alpha * np.eye(len(mean)), xy / std) / std
    return np.concatenate([[y - mean @ w], w])


def predict(df: DataFrame, columns: list[str], build: Featurize, coefs: list[np.ndarray], name: str,
            logistic: bool = False) -> DataFrame:
    """Add ``name``: array of the members' predictions."""
    table = np.column_stack(coefs)

    @F.pandas_udf("array<double>")
    def score(pdf: pd.DataFrame) -> pd.Series:
        x = build(pdf)
        z = np.column_stack([np.ones(len(pdf)), x]) @ table
        if logistic:
            z = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return pd.Series(list(z))

    return df.withColumn(name, score(F.struct(*columns)))


def linear_baseline(train: DataFrame, test: DataFrame, sequence_col: str, target: str, kind: str, name: str) -> DataFrame:
    """Test rows with the prediction of one linear baseline."""
    build = {
        "gc_length_baseline": lambda: gc_length_matrix(sequence_col),
        "kmer_ridge_or_logistic": lambda: kmer_features(sequence_col, 3),
        "kmer4_linear_probe": lambda: kmer_features(sequence_col, 4),
        "least_squares_fallback": lambda: gc_length_matrix(sequence_col),
    }[kind]()
    g = gram(train, [sequence_col], build, target)
    if not g or test.isEmpty():
        return test.withColumn(name, F.lit(None).cast("double"))
    coef = ridge_all(g[0]) if kind == "least_squares_fallback" else ridge_scaled(g[0])
    return predict(test, [sequence_col], build, [coef], "__p").withColumn(name, F.col("__p")[0]).drop("__p")


def weighted_linear_baselines(df: DataFrame, sequence_col: str, target: str, kind: str, name: str, weights: str, members: int) -> DataFrame:
    """Add ``name``: one prediction per member; member m is fitted on all rows with their m-th weight.

    Features are built once for all members; a member without weight predicts null.
    """
    build = gc_length_matrix(sequence_col) if kind == "gc_length_baseline" else kmer_features(sequence_col, {"kmer_ridge_or_logistic": 3}.get(kind, 4))
    grams = gram(df, [sequence_col], build, target, weights)
    if not grams:
        return df.withColumn(name, F.array_repeat(F.lit(None).cast("double"), members))
    fitted = [m for m, g in enumerate(grams) if g[0, 0] > 0]
    scored = predict(df, [sequence_col], build, [ridge_scaled(grams[m]) for m in fitted], "__p") if fitted else df
    cells = [F.col("__p")[fitted.index(m)] if m in fitted else F.lit(None).cast("double") for m in range(members)]
    return scored.withColumn(name, F.array(*cells)).drop("__p")


def sequence_vector(sequence_col: str, k: int) -> Column:
    head = seq.gc_length_features(sequence_col)
    return array_to_vector(F.concat(head, seq.kmer_frequencies(sequence_col, k)))


def logistic_baseline(train: DataFrame, test: DataFrame, sequence_col: str, label: str, k: int, name: str) -> DataFrame:
    """Unit-penalty logistic regression; a constant when training holds one class only."""
    from pyspark.ml.classification import LogisticRegression

    seen = train.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if not seen["n"]:
        return test.withColumn(name, F.lit(None).cast("double"))
    if seen["lo"] == seen["hi"]:
        return test.withColumn(name, F.lit(float(seen["lo"])))
    vector = array_to_vector(seq.gc_length_features(sequence_col)) if k == 0 else sequence_vector(sequence_col, k)
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / seen["n"], maxIter=100, standardization=True,
                               predictionCol="__class", probabilityCol="__prob", rawPredictionCol="__raw").fit(
        train.select(vector.alias("__x"), F.col(label).cast("double").alias("__y")))
    scored = model.transform(test.withColumn("__x", vector))
    return scored.withColumn(name, vector_to_array("__prob")[1]).drop("__x", "__raw", "__prob", "__class")


def forest_baseline(train: DataFrame, test: DataFrame, sequence_col: str, target: str, name: str, trees: int = 100,
                    depth: int = 10, seed: int = 13, classify: bool = False) -> DataFrame:
    """Random forest on 3-mer frequencies; ``depth`` may be raised to 30, the limit of the library.

    Without training rows the prediction is null; with one class it is that class.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    seen = train.agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if not seen["n"]:
        return test.withColumn(name, F.lit(None).cast("double"))
    if classify and seen["lo"] == seen["hi"]:
        return test.withColumn(name, F.lit(float(seen["lo"])))
    own = {"probabilityCol": "__prob", "rawPredictionCol": "__raw"} if classify else {}
    kind = RandomForestClassifier if classify else RandomForestRegressor
    model = kind(featuresCol="__x", labelCol="__y", numTrees=trees, minInstancesPerNode=2, maxDepth=depth, seed=seed,
                 featureSubsetStrategy="sqrt" if classify else "all", predictionCol="__p", **own).fit(
        train.select(sequence_vector(sequence_col, 3).alias("__x"), F.col(target).cast("double").alias("__y")))
    scored = model.transform(test.withColumn("__x", sequence_vector(sequence_col, 3)))
    value = vector_to_array("__prob")[1] if classify else F.col("__p")
    return scored.withColumn(name, value).drop("__x", "__p", "__raw", "__prob")


# Names of the baselines.
BASELINES = ("gc_length_baseline", "kmer_ridge_or_logistic", "kmer_random_forest", "kmer4_linear_probe")


def run_baselines(train: DataFrame, test: DataFrame, sequence_col: str, target: str, task: str = "regression",
                  seed: int = 13, names: tuple[str, ...] = BASELINES) -> DataFrame:
    """Test rows with one prediction column per baseline, keyed by row and never by position."""
    out = test
    for name in names:
        if name == "kmer_random_forest":
            out = forest_baseline(train, out, sequence_col, target, name, seed=seed, classify=task == "classification")
        elif task == "classification":
            k = {"gc_length_baseline": 0, "kmer_ridge_or_logistic": 3, "kmer4_linear_probe": 4}[name]
            out = logistic_baseline(train, out, sequence_col, target, k, name)
        else:
            out = linear_baseline(train, out, sequence_col, target, name, name)
    return out


def best_baseline(scores: DataFrame, name_col: str, value_col: str, order_col: str, keys: list[str] = []) -> DataFrame:
    """Largest primary metric; the first listed baseline wins a tie."""
    best = F.max_by(F.struct(name_col, value_col), F.struct(F.col(value_col), (-F.col(order_col)).alias("o")))
    return scores.where(F.col(value_col).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{name_col}", f"b.{value_col}")


# --- ensembles --------------------------------------------------------------------

def poisson_weights(members: int, seed: int, row_id: str, first_plain: bool = False) -> Column:
    """Bootstrap counts per member: Poisson(1) from a hashed uniform, no shuffle and no row index."""
    cells = [F.lit(1.0) if first_plain and m == 0 else poisson(uniform(F.lit(seed), F.lit(m), row_id)) for m in range(members)]
    return F.array(*cells)


def fit_ensemble(train: DataFrame, columns: list[str], build: Featurize, target: str, row_id: str, members: int = 5,
                 seed: int = 13, alpha: float = 1.0, first_plain: bool = False) -> list[np.ndarray]:
    """Ridge members on bootstraps; rows without a target or a feature column teach nothing."""
    told = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in dict.fromkeys([*columns, target])])
    weighted = train.where(told).withColumn("__w", poisson_weights(members, seed, row_id, first_plain))
    return [ridge_scaled(g, alpha) for g in gram(weighted, columns, build, target, "__w")]


def ensemble_mean_std(raw: str, sample: bool = False) -> tuple[Column, Column]:
    """Mean and standard deviation over the members (population, or sample with ddof 1)."""
    n = F.size(raw)
    mean = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x) / n
    ss = F.aggregate(raw, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return mean, F.sqrt(ss / (F.greatest(n - 1, F.lit(1)) if sample else n))


def calibrated_std(scored: DataFrame, std: str, error: float) -> Column:
    return F.sqrt(F.col(std) * F.col(std) + F.lit(error) * F.lit(error))


def calibration_rmse(scored: DataFrame, mean: str, target: str) -> float:
    return scored.agg(F.sqrt(F.avg((F.col(mean) - F.col(target)) * (F.col(mean) - F.col(target)))).alias("r")).first()["r"] or 0.0


#: Bytes of head weights that are broadcast together.
HEAD_BYTES = 16 << 20


def score_embeddings(df: DataFrame, embedding: str, heads: DataFrame, logistic: bool = False, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Mean and sample deviation of linear heads (member, bias, weights) over an embedding column.

    Heads are a matrix cut into blocks. A task multiplies a batch of rows with one block; each row
    carries the number, mean and squared deviations of its scores so far, merged block by block
    by the pairwise formula. One block is broadcast at a time, so any number of heads can be scored.
    """
    spark = df.sparkSession
    table = cut(heads.select("member", F.col("bias").cast("double").alias("bias"), F.col("weights").cast("array<double>").alias("weights")))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("weights")).alias("d")).first()
    blocks = max(1, -(-size["n"] * 8 * (size["d"] or 1) // head_bytes))
    state = df.withColumns({"__n": F.lit(0.0), "__mean": F.lit(0.0), "__m2": F.lit(0.0)})
    for number in range(blocks):
        held = table.where(F.pmod(F.xxhash64("member"), F.lit(blocks)) == number).orderBy("member").toArrow()
        if not held.num_rows:
            continue
        shared = spark.sparkContext.broadcast((np.array(held.column("weights").to_pylist(), float).T, held.column("bias").to_numpy()))

        @F.pandas_udf("n double, mean double, m2 double")
        def merge(x: pd.Series, n: pd.Series, mean: pd.Series, m2: pd.Series) -> pd.DataFrame:
            w, bias = shared.value
            there = x.notna().to_numpy()
            out = np.full((len(x), 3), np.nan)
            if there.any():
                z = np.stack(x[there].to_numpy()).astype(float) @ w + bias
                if logistic:
                    z = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                own, k = z.mean(axis=1), z.shape[1]
                spread = ((z - own[:, None]) ** 2).sum(axis=1)
                before, old = n.to_numpy()[there], mean.to_numpy()[there]
                gap, total = own - old, before + k
                out[there] = np.column_stack([total, old + gap * k / total, m2.to_numpy()[there] + spread + gap * gap * before * k / total])
            return pd.DataFrame(out, columns=["n", "mean", "m2"])

        state = state.withColumn("__s", merge(F.col(embedding).cast("array<double>"), "__n", "__mean", "__m2")).withColumns(
            {"__n": F.col("__s.n"), "__mean": F.col("__s.mean"), "__m2": F.col("__s.m2")}).drop("__s")
        if blocks > 1:
            state = cut(state)
            shared.destroy()
    told = (F.col("__n") > 0) & ~F.isnan("__n")
    deviation = F.sqrt(F.col("__m2") / F.greatest(F.col("__n") - 1, F.lit(1.0)))
    return state.withColumns({"prediction": F.when(told, F.col("__mean")), "uncertainty": F.when(told, deviation)}).drop("__n", "__mean", "__m2")


# --- logistic ensembles -----------------------------------------------------------

def stratified_weights(train: DataFrame, label: str, members: int, seed: int, row_id: str, first_plain: bool) -> DataFrame:
    """Add ``__w``: bootstrap weights per member under which each class keeps its own number of rows.

    Poisson counts are scaled per member and class, so no member sees another share of classes or misses one.
    """
    rows = train.withColumn("__w", poisson_weights(members, seed, row_id, first_plain))
    sums = rows.select(label, F.posexplode("__w").alias("member", "w")).groupBy(label, "member").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()  # classes x members numbers
    scale = {(r[label], r["member"]): r["n"] / r["w"] if r["w"] else 0.0 for r in sums}
    cells = {c: F.array(*[F.lit(scale.get((c, m), 0.0)) for m in range(members)]) for c in sorted({k for k, _ in scale})}
    factor = F.coalesce(*[F.when(F.col(label) == c, a) for c, a in cells.items()]) if cells else F.array_repeat(F.lit(1.0), members)
    return rows.withColumn("__w", F.zip_with("__w", factor, lambda w, f: w * f))


def _newton_sums(df: DataFrame, columns: list[str], build: Featurize, label: str, weights: str, coefs: np.ndarray) -> np.ndarray:
    """Per member: loss, gradient and curvature of the weighted logistic loss, one row of sums each."""
    members, width = coefs.shape

    def partial(batches):
        total = np.zeros((members, 1 + width + width * width))
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.column_stack([np.ones(len(pdf)), build(pdf)])
            y, w = pdf[label].to_numpy(dtype=float), np.stack(pdf[weights].to_numpy()).astype(float)
            for m in range(members):
                f = z @ coefs[m]
                p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
                total[m, 0] += (w[:, m] * (np.logaddexp(0, f) - y * f)).sum()
                total[m, 1:1 + width] += z.T @ (w[:, m] * (p - y))
                total[m, 1 + width:] += (z.T @ (z * (w[:, m] * p * (1 - p))[:, None])).ravel()
        yield pd.DataFrame({"member": range(members), "cells": list(total)})

    parts = df.select(*dict.fromkeys([*columns, label, weights])).mapInPandas(partial, "member int, cells array<double>")
    summed = parts.select("member", F.posexplode("cells").alias("at", "v")).groupBy("member", "at").agg(F.sum("v").alias("v"))
    out = np.zeros((members, 1 + width + width * width))
    for r in summed.collect():  # members x width^2 numbers, whatever the rows
        out[r["member"], r["at"]] = r["v"]
    return out


def fit_logistic_ensemble(train: DataFrame, columns: list[str], build: Featurize, label: str, row_id: str, width: int, members: int = 5,
                          seed: int = 13, penalty: float = 1.0, first_plain: bool = False, steps: int = 30) -> list[np.ndarray]:
    """Coefficients of logistic members on stratified bootstraps; ``label`` is 0 or 1, ``width`` the number of features.

    All members take their damped Newton steps together: one job a step over shared features. The penalty
    is half the squared length of the weights, the intercept is free.
    """
    rows = cut(stratified_weights(train.where(F.col(label).isNotNull()), label, members, seed, row_id, first_plain))
    side = 1 + width
    ridge = np.diag([0.0] + [penalty] * width)
    best = np.zeros((members, side))
    known = [None] * members  # per member: loss, gradient, curvature at its best point
    trial, damp, done = best.copy(), np.full(members, 1e-9), np.zeros(members, bool)
    for _ in range(steps):
        sums = _newton_sums(rows, columns, build, label, "__w", trial)
        for m in np.flatnonzero(~done):
            loss = sums[m, 0] + 0.5 * trial[m] @ ridge @ trial[m]
            if known[m] is not None and loss > known[m][0] + 1e-9 * abs(known[m][0]):
                damp[m] = max(1e-3, damp[m] * 16)
            else:
                gradient = sums[m, 1:1 + side] + ridge @ trial[m]
                done[m] = np.abs(gradient).max() < 1e-7 * max(1.0, abs(loss))
                known[m] = (loss, gradient, sums[m, 1 + side:].reshape(side, side) + ridge)
                best[m], damp[m] = trial[m], damp[m] / 4
            trial[m] = best[m] - np.linalg.solve(known[m][2] + damp[m] * np.eye(side), known[m][1])
        if done.all():
            break
    return list(best)


# --- forests, tree by tree --------------------------------------------------------

def forest_nodes(model, path: str, spark) -> DataFrame:
    """(tree, node, feature, threshold, lower, upper, prediction): the nodes of a fitted forest, written to ``path``.

    Leaves have feature -1; children are places within the tree.
    """
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(F.col("leftChild") < 0, -1).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"), F.col("leftChild").alias("lower"),
        F.col("rightChild").alias("upper"), "prediction")


def tree_spread(df: DataFrame, nodes: DataFrame, vector: str, block_nodes: int = 1_000_000) -> DataFrame:
    """Add the mean and the population deviation of the single trees' predictions for an array of features.

    Trees are dealt to blocks of about ``block_nodes`` nodes, broadcast one at a time; a batch of rows walks all trees of a
    block at once, one level a step, and carries its sums on.
    """
    spark = df.sparkSession
    table = cut(nodes)
    blocks = max(1, -(-table.count() // block_nodes))
    state = df.withColumns({"__n": F.lit(0.0), "__sum": F.lit(0.0), "__square": F.lit(0.0)})
    for number in range(blocks):
        held = table.where(F.pmod(F.xxhash64("tree"), F.lit(blocks)) == number).orderBy("tree", "node").toPandas()
        if not len(held):
            continue
        first = held["tree"].ne(held["tree"].shift()).to_numpy().nonzero()[0]
        base = np.repeat(first, np.diff(np.r_[first, len(held)])) - held["node"].to_numpy()[np.repeat(first, np.diff(np.r_[first, len(held)]))]
        shared = spark.sparkContext.broadcast((
            first, held["feature"].to_numpy(), held["threshold"].to_numpy(), base + held["lower"].to_numpy(), base + held["upper"].to_numpy(),
            held["prediction"].to_numpy()))

        @F.pandas_udf("n double, sum double, square double")
        def walk(x: pd.Series, n: pd.Series, total: pd.Series, square: pd.Series) -> pd.DataFrame:
            roots, feature, threshold, lower, upper, prediction = shared.value
            rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))
            at = np.tile(roots, (len(rows), 1))
            while (inner := feature[at] >= 0).any():
                low = np.take_along_axis(rows, np.maximum(feature[at], 0), axis=1) <= threshold[at]
                at = np.where(inner, np.where(low, lower[at], upper[at]), at)
            value = prediction[at]
            return pd.DataFrame({"n": n + len(roots), "sum": total + value.sum(axis=1), "square": square + (value ** 2).sum(axis=1)})

        state = state.withColumn("__s", walk(F.col(vector), "__n", "__sum", "__square")).withColumns(
            {"__n": F.col("__s.n"), "__sum": F.col("__s.sum"), "__square": F.col("__s.square")}).drop("__s")
        if blocks > 1:
            state = cut(state)
            shared.destroy()
    mean = F.col("__sum") / F.col("__n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("__square") / F.col("__n") - mean * mean))
    return state.withColumns({"tree_mean": mean, "tree_std": spread}).drop("__n", "__sum", "__square")


# --- encoders and pooling ---------------------------------------------------------

def category_levels(df: DataFrame, columns: list[str], max_categories: int = 100) -> DataFrame:
    """(column, value, code): the most frequent values (first seen wins ties by name), then one unknown slot."""
    from .ordered import top_k

    text = lambda c: F.when(F.coalesce(F.col(c).cast("string") != "", F.lit(False)), F.col(c).cast("string")).otherwise(MISSING)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("s")).groupBy("s.column", "s.value").agg(F.count(F.lit(1)).alias("rows"))
    top = top_k(counts, max_categories - 1, [F.desc("rows"), F.col("value")], ["column"], F.col("value"))
    known = top.select("column", "value", (F.col("rank") - 1).alias("code"))
    unknown = known.groupBy("column").agg(F.count(F.lit(1)).cast("int").alias("code")).select(
        "column", F.lit(UNKNOWN).alias("value"), "code")
    return known.unionByName(unknown)


def encode_categories(df: DataFrame, levels: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``{column}_code``; values outside the table get the unknown code. Tables hold at most max_categories rows."""
    out = df
    for c in columns:
        mine = levels.where(F.col("column") == c)
        text = F.when(F.coalesce(F.col(c).cast("string") != "", F.lit(False)), F.col(c).cast("string")).otherwise(MISSING)
        other = F.broadcast(mine.where(F.col("value") == UNKNOWN).select(F.col("code").alias("__u")))
        known = F.broadcast(mine.select(F.col("value").alias("__v"), F.col("code").alias("__c")))
        out = out.withColumn("__t", text).join(known, F.col("__t") == F.col("__v"), "left").join(other)
        out = out.withColumn(f"{c}_code", F.coalesce("__c", "__u")).drop("__t", "__v", "__c", "__u")
    return out


def zscore(df: DataFrame, array_col: str, name: str) -> DataFrame:
    """Per-dimension z-score with population deviation; a flat dimension is only centred."""
    dims = df.select(F.posexplode(array_col).alias("d", "x")).groupBy("d").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    fit = dims.agg(F.array_sort(F.collect_list(F.struct("d", "m", F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s")).alias("s")))).alias("fit"))
    return df.join(F.broadcast(fit)).withColumn(
        name, F.zip_with(array_col, "fit", lambda x, f: (x - f["m"]) / f["s"])).drop("fit")


def pool(tokens, mask, method: str = "mean") -> Column:
    """Pool an array of token vectors into one vector: masked mean, first token, or softmax of the token means."""
    tokens, mask = col(tokens), col(mask)
    dims = F.sequence(F.lit(0), F.size(tokens[0]) - 1)
    if method == "cls":
        return tokens[0]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    if method == "mean":
        weights = F.transform(mask, lambda m: m.cast("double"))
        norm = F.greatest(total(weights), F.lit(1.0))
    elif method == "attention":
        means = F.transform(tokens, lambda t: total(F.transform(t, lambda x: x.cast("double"))) / F.size(t))
        masked = F.zip_with(means, mask, lambda s, m: F.when(m == 0, F.lit(-1e9)).otherwise(s))
        top = F.array_max(masked)
        weights = F.transform(masked, lambda s: F.exp(s - top))
        norm = total(weights)
    else:
        raise ValueError(f"unsupported pooling method {method!r}")
    return F.transform(dims, lambda d: total(F.zip_with(tokens, weights, lambda t, w: t[d] * w)) / norm)


def score_table(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user function that returns exactly one (mean, uncertainty) row per input row."""
    def run(batches):
        for pdf in batches:
            out = fn(pdf)
            if len(out) != len(pdf):
                raise ValueError(f"score function returned {len(out)} rows for {len(pdf)}")
            yield pd.concat([pdf.reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, schema)
