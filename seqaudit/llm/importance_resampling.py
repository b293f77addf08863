"""Importance resampling towards a target distribution, with a distributed quickselect.

Features. A text's words are runs of letters, digits and characters outside ASCII, A-Z
lowered; its features are all runs of one to ``ORDER`` words, repeats counted, hashed by
CRC-32 into ``BUCKETS`` buckets. Each task counts its texts into one array; only the arrays'
cells are added up. The gain of a bucket is the floored, scaled logarithm of its share in
the target over its share in the documents, and a document's weight is the floored mean of
the gains of its features, read from the one array of gains that every task gets.

Draw. A Gumbel number from a hash of the id is added to the weight, so the k largest scores
are a draw without replacement in proportion to the exponentials of the weights. The k-th
key (score, id, row mark) is found without a sort: each round takes ``PIVOTS`` random keys
of the range that is left, counts the keys before, at and between them exactly, and goes on
with the one cell that holds the k-th. The range shrinks by about ``PIVOTS`` a round, its rows
are written before the next, and the search ends when the k-th key is itself a pivot. Only
the winners are sorted, by ranges; the others are never ordered.

Defined results. A null or empty text, or one without words, has no features and weight 0.
A document under ``least_words`` words, or with a null id, takes no part in the draw; without
an id the score is null, too. Ties of score go to the smaller id. Each row of a repeated id
counts and may be drawn; among rows of equal score and id the one with more features comes
first, among wholly equal rows any. Empty tables give empty results, an empty target gives
gains from the smoothing alone. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import row_number
from ..session import cut, parallelism, spread

ORDER = 2
BUCKETS = 10_000
SCALE = 1000
#: Random keys a round counts against.
PIVOTS = 16
#: Winners a sorting task gets, at least and at most; between them they follow the number of tasks.
LEAST_SORTED, MOST_SORTED = 10_000, 1_000_000

# bytes that are no part of a word become spaces, A-Z become a-z
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes | None, order: int = ORDER) -> tuple[int, np.ndarray]:
    """(number of words, CRC-32 of every feature) of a whole text."""
    words = (text or b"").translate(_WORD_BYTES).split()
    crcs = last = list(map(zlib.crc32, words))
    for width in range(2, min(order, len(words)) + 1):
        # a run of one word more: the checksum goes on over a space and the next word
        last = list(map(zlib.crc32, words[width - 1:], map(zlib.crc32, repeat(b" "), last)))
        crcs = crcs + last
    return len(words), np.array(crcs, np.int64)


def _texts(df: DataFrame, text: str, *more: Column) -> DataFrame:
    return spread(df.select(*more, F.col(text).cast("string").cast("binary").alias("text")))


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features of all texts by bucket. One array a task is added up; ``buckets`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(features(t, order)[1] % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in _texts(df, text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored, scaled log ratio of the smoothed shares of each bucket."""
    k = len(own)
    have, want = float(own.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (have + k) / ((s + 1.0) * (want + k))))
                     for s, t in zip(own.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket, whatever the tables' size

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, counts, weights = [], [], []
            for t in batch.column(1).to_pylist():
                n, crcs = features(t, order)
                words.append(n)
                counts.append(len(crcs))
                weights.append(int(gain[crcs % len(gain)].sum()) // len(crcs) if len(crcs) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (words, counts, weights))], ["id", "n_words", "n_features", "weight"])

    narrow = _texts(docs, text, F.col(id_col).cast("bigint").alias("id"))
    return narrow.mapInArrow(weigh, "id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: Column, seed: int) -> Column:
    """Floored, scaled Gumbel number from a hash of (seed, id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 0) -> tuple | None:
    """The ``k``-th (from 1) of the distinct rows of ``keys`` in the order of its columns, none of them null.

    Exact three-way counts around random pivots; None if there are fewer rows. ``keys`` should be
    written (``cut``): it is read once a round until the range that is left is written in its place.
    """
    names = keys.columns
    key = F.struct(*names)
    types = dict(keys.dtypes)
    lit = lambda row: F.struct(*[F.lit(v).cast(types[n]).alias(n) for n, v in zip(names, row)])
    live, turn = keys, 0
    while k > 0:
        drawn = live.orderBy(F.xxhash64(F.lit(seed + turn), *names), *names).limit(pivots).collect()  # at most ``pivots`` rows
        if not drawn:
            return None
        marks = sorted(tuple(r) for r in drawn)
        # cell 2i lies below pivot i, cell 2i + 1 is the pivot itself, the last lies above them all
        def cell(low: int, high: int) -> Column:
            if low == high:
                return F.lit(2 * low)
            i = (low + high) // 2
            at = lit(marks[i])
            return F.when(key < at, cell(low, i)).when(key == at, 2 * i + 1).otherwise(cell(i + 1, high))

        counted = {r["cell"]: r["n"] for r in live.groupBy(cell(0, len(marks)).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for c in range(2 * len(marks) + 1):
            n = counted.get(c, 0)
            if k <= n:
                break
            k -= n
        else:
            return None
        if c % 2:
            return marks[c // 2]
        here = F.lit(True)
        if c > 0:
            here &= key > lit(marks[c // 2 - 1])
        if c < 2 * len(marks):
            here &= key < lit(marks[c // 2])
        live, turn = cut(live.where(here)), turn + 1
    return None


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, id_col: str = "doc_id",
             text: str = "text", target_text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; ``rank`` from 1 for the drawn rows, else null.

    ``percent`` of the documents that have ``least_words`` words are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, text, buckets, order), bucket_counts(target, target_text, buckets, order))
    scored = weighed(docs, gain, id_col, text, order).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = cut(scored.withColumn("mark", F.monotonically_increasing_id()))  # written once: the marks stay as they are
    judged = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    wanted = percent * scored.where(judged).count() // 100
    order_of = {"low": -F.col("score"), "id": F.col("id"), "fewer": -F.col("n_features"), "mark": F.col("mark")}
    last = kth_key(scored.where(judged).select(*[c.alias(n) for n, c in order_of.items()]), wanted, seed=seed)
    if last is None:
        return scored.drop("mark").withColumn("rank", F.lit(None).cast("bigint"))
    types = {"low": "bigint", "id": "bigint", "fewer": "bigint", "mark": "bigint"}
    own = F.struct(*[c.alias(n) for n, c in order_of.items()])
    drawn = judged & (own <= F.struct(*[F.lit(v).cast(types[n]).alias(n) for n, v in zip(order_of, last)]))
    rows_per_task = min(MOST_SORTED, max(LEAST_SORTED, wanted // (4 * parallelism(docs.sparkSession))))
    winners = row_number(scored.where(drawn), "rank", list(order_of.values()), rows_per_task=rows_per_task)
    others = scored.where(~F.coalesce(drawn, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return winners.unionByName(others).drop("mark")
