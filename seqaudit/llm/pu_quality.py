"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents that a label calls good; everything else in the training
fold, positives included, is unlabelled web text. With the class prior p the risk

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])          (l: logistic loss)

is unbiased where the bracket is positive and is kept from falling below zero, so the
classifier cannot win by calling positives unlabelled. f is linear in a few measures of
the whole text (``MEASURES``). Damped Newton steps minimise it; each step is one job that
adds gradients, curvatures and risks of all training rows inside the tasks and brings a
few hundred sums to the driver. While the bracket is negative its gradient is reversed,
as the non-negative estimator asks.

The prior is the share of good documents among the labelled ones of the training fold
(smoothed), unless it is given.

Defined results. A null or empty text has all measures zero and a score like any other.
A label of a repeated id is trusted only if all its labels are 1. Null labels and ids never
train. Without positives the score of every document is the prior. Repeated documents get
equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

MEASURES = (
    "log_words", "short", "word_length", "long_words", "distinct", "repeat", "top_word", "symbols", "capitals", "shouted",
    "digits", "marks", "sentence_ends", "bars", "line_copies", "words_per_line", "short_words", "lower_start",
)
STEPS = 25
RIDGE = 1e-3
#: The correction's slack and step share (beta and gamma of the estimator).
SLACK, REVERSED = 0.0, 0.5
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]=_~^\\]")
_MARKS = re.compile(r"[!?]")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_DIGITS = re.compile(r"\d")


def measures(text: str | None) -> list[float]:
    """Bounded measures of a whole text; all zero without a word."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    chars = sum(map(len, words))
    top = max(counts.values())
    share = lambda k: min(1.0, k / n)
    return [
        math.log1p(n) / 10, 1.0 / (1.0 + n / 10), min(1.0, chars / n / 15), share(sum(len(w) > 15 for w in words)),
        len(counts) / n ** 0.8 if n > 1 else 1.0, share(sum(a == b for a, b in zip(words, words[1:]))), top / n,
        share(len(_SYMBOLS.findall(text))), min(1.0, len(_UPPER.findall(text)) / chars), share(sum(map(str.isupper, words))),
        min(1.0, len(_DIGITS.findall(text)) / chars * 5), share(len(_MARKS.findall(text))),
        min(1.0, 5 * sum(w[-1] in ".!?:" for w in words) / n), share(words.count("|")),
        1 - len(set(lines)) / len(lines) if lines else 0.0, min(1.0, n / max(1, len(lines)) / 200),
        share(sum(len(w) <= 3 for w in words)), share(sum(map(str.islower, words))),
    ]


def _row(text: str | None) -> list[float]:
    m = measures(text)
    # squares let a measure count at both ends
    return [1.0, *m, *(x * x for x in m)]


WIDTH = 1 + 2 * len(MEASURES)


def fold_column(id_col: Column, folds: int = 3) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the measures of every whole text."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(measure, "id bigint, x array<double>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, WIDTH)


def _sums(rows: DataFrame, w: np.ndarray) -> dict[str, np.ndarray]:
    """Over all training rows (x, positive): counts, losses, gradients and curvatures at ``w``."""
    d = len(w)
    layout = [("n_u", 1), ("n_p", 1), ("loss_p", 1), ("loss_u_neg", 1), ("loss_p_neg", 1), ("sum_p", d), ("grad_u", d),
              ("grad_p", d), ("grad_p_neg", d), ("curve_u", d * d), ("curve_p", d * d)]
    size = sum(k for _, k in layout)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = _matrix(batch.column(0))
            good = np.asarray(batch.column(1), dtype=bool)
            f = x @ w
            s = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
            soft = np.logaddexp(0, f)  # l(-f)
            curve = s * (1 - s)
            p = x[good]
            total += np.concatenate([
                [len(x), good.sum(), np.logaddexp(0, -f[good]).sum(), soft.sum(), soft[good].sum()], p.sum(0), x.T @ s,
                p.T @ (s[good] - 1), p.T @ s[good], (x.T * curve @ x).ravel(), (p.T * curve[good] @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype="int32")), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    summed = rows.select("x", "positive").mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    for r in summed.collect():  # one number per k, whatever the rows
        out[r["k"]] = r["v"]
    return {name: part for (name, _), part in zip(layout, np.split(out, np.cumsum([k for _, k in layout])[:-1]))}


def fit(rows: DataFrame, prior: float, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the non-negative risk over ``rows`` (x, positive)."""
    w, best, damp = np.zeros(WIDTH), None, 1e-3
    w[0] = math.log(prior / (1 - prior))
    trial = w
    for _ in range(steps):
        s = _sums(rows, trial)
        n_u, n_p = s["n_u"][0], s["n_p"][0]
        if not n_p:
            return w
        negative = s["loss_u_neg"][0] / n_u - prior * s["loss_p_neg"][0] / n_p
        risk = prior * s["loss_p"][0] / n_p + max(0.0, negative) + ridge * float(trial[1:] @ trial[1:])
        if best is not None and risk > best[0] + 1e-12:
            damp *= 8  # step back and take a shorter one
        else:
            done = best is not None and best[0] - risk < 1e-7
            best, w = (risk, s, negative), trial
            damp = max(damp / 4, 1e-6)
            if done:
                break
        _, s, negative = best
        push = np.concatenate([[0.0], np.full(WIDTH - 1, 2 * ridge)])
        grad_neg = s["grad_u"] / n_u - prior * s["grad_p_neg"] / n_p
        if negative < -SLACK:  # the estimator overfits: raise the bracket again
            grad = -REVERSED * grad_neg + push * w
        else:
            grad = prior * s["grad_p"] / n_p + grad_neg + push * w
        curve = s["curve_u"].reshape(WIDTH, WIDTH) / n_u + np.diag(push + damp)
        trial = w - np.linalg.solve(curve, grad)
        if damp > 1e6:
            break
    return w


def train(features: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id",
          quality: str = "quality") -> tuple[np.ndarray, float]:
    """(weights, prior) from the rows of ``features`` (id, x) and the labels of their ids."""
    trusted = labels.where(F.col(id_col).isNotNull() & F.col(quality).isNotNull()).groupBy(
        F.col(id_col).cast("bigint").alias("id")).agg(F.min(quality).alias("quality"))
    rows = cut(features.where("id is not null").join(trusted, "id", "left").select(
        "x", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("positive"), F.col("quality").isNotNull().alias("labelled")))
    if prior is None:
        seen = rows.where("labelled").agg(F.count(F.lit(1)), F.sum(F.col("positive").cast("bigint"))).first()
        prior = ((seen[1] or 0) + 1) / (seen[0] + 2)
    return fit(rows, prior), prior


def score(features: DataFrame, w: np.ndarray) -> DataFrame:
    """(id, score) from (id, x); scores lie between 0 and 1."""
    f = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return features.select("id", (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), f))))).alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels and texts of the held-out fold never train."""
    features = cut(measured(docs))
    fold = fold_column(F.col("id"), folds)
    w, _ = train(features.where(fold != held_out), labels.where(fold_column(F.col("doc_id"), folds) != held_out))
    scored = score(features, w)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
