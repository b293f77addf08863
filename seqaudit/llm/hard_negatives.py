"""Hard negatives by slot-decomposed selection.

Every anchor has its first ``positives`` other rows of the same label; a positive of score p
wants the first ``negatives`` rows of other labels with ``low`` % of p <= score <= ``high`` % of p.
These windows overlap. The positives' upper limits, in descending order, split the scores
into disjoint slots, so a row falls into at most one slot of an anchor however many windows
hold it. Tasks keep the first rows of each slot (a combiner: what another task adds cannot
bring back what was left out), a window function merges them, and the windows are answered
from the last slot upwards: the first rows under limit j are those of slot j followed by the
answer under limit j + 1.

Scores are integer inner products of floored, scaled components, exact in doubles: products
of whole blocks of anchors and rows. Anchors are dealt to blocks of about ``BLOCK`` by a hash;
only one block is broadcast at a time, its result is written and its broadcast destroyed
before the next. Positives meet rows of their own label only. Of equal vectors of one label
a batch keeps the first ``positives + 1`` or ``negatives`` ids, which are all that can be chosen, so a
vector that a third of all rows share costs as much as any other.

Defined results. Rows with a null id, label or vector, or with a null or non-finite component,
take no part. Missing components count as zero, so vectors of different lengths can be
compared. Scaled components are clipped to +-2**20 (x beyond +-4096), so that inner products of up
to 4096 components stay exact. Of rows that repeat an anchor's id the one with the smallest
(label, vector) is the anchor; a row with the anchor's id is never its partner. Rows of equal id
and equal score are one partner. Ties of score go to the smaller id. Anchors without positives, and positives
without negatives, have no rows. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

SCALE = 256
#: Anchors broadcast together: with 64 components some 2 MB.
BLOCK = 4096
#: Scores held at once, per task.
CELLS = 2_000_000
CLIP = 2 ** 20
_NONE = -(2.0 ** 62)


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their components scaled and floored, padded with zeros)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # of the rows that are not null
    x = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = lengths >= 0
    good[owner[~np.isfinite(x)]] = False
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    place = np.arange(len(x)) - starts[owner]
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[owner, place] = np.clip(np.floor(SCALE * x), -CLIP, CLIP)
    return good, out[good]


def _places(sorted_groups: np.ndarray) -> np.ndarray:
    """Place from 0 of each row within its group."""
    start = np.flatnonzero(np.r_[True, np.diff(sorted_groups) != 0][:len(sorted_groups)])
    return np.arange(len(sorted_groups)) - np.repeat(start, np.diff(np.r_[start, len(sorted_groups)]))


def _first_copies(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Rows in the order of ids, at most ``keep`` for each equal (label, vector)."""
    both = np.ascontiguousarray(np.column_stack([labels.astype(float), x]))
    both += 0.0  # one zero
    _, group = np.unique(both.view(np.dtype((np.void, both.dtype.itemsize * both.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    order = order[np.r_[True, (np.diff(group[order]) != 0) | (np.diff(ids[order]) != 0)][:len(order)]]
    rows = order[_places(group[order]) < keep]
    return rows[np.argsort(ids[rows], kind="stable")]


class _Best:
    """The first ``k`` (score, id) of each cell, over all batches of a task."""

    def __init__(self, cells: int, k: int):
        self.k = k
        self.cell, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(cells, _NONE)

    def add(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(cell):
            return
        cell, score, ids = (np.concatenate(x) for x in ((self.cell, cell), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, cell))
        cell, score, ids = cell[order], score[order], ids[order]
        new = np.r_[True, (np.diff(cell) != 0) | (np.diff(score) != 0) | (np.diff(ids) != 0)]
        cell, score, ids = cell[new], score[new], ids[new]
        place = _places(cell)
        self.cell, self.score, self.id = (x[place < self.k] for x in (cell, score, ids))
        full = place == self.k - 1
        self.least[cell[full]] = score[full]

    def rows(self, names: np.ndarray, width: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(names[self.cell // width]), pa.array((self.cell % width).astype(np.int32)), pa.array(self.score), pa.array(self.id)],
            ["anchor", "slot", "score", "id"])


_FOUND = "anchor bigint, slot int, score bigint, id bigint"


def _padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))  # type: ignore[return-value]


def _same_label(rows: DataFrame, shared, k: int) -> DataFrame:
    """(anchor, slot 0, score, id): each task's first ``k`` other rows of the anchor's label."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, labels, anchors, _ = shared.value
        best = _Best(len(names), k)
        of_label = {label: np.flatnonzero(labels == label) for label in np.unique(labels).tolist()}
        for batch in batches:
            good, x = _vectors(batch.column(2))
            ids, own = (batch.column(c).to_numpy(zero_copy_only=False)[good] for c in (0, 1))
            first = _first_copies(ids, own, x, k + 1)
            ids, own, x = ids[first], own[first], x[first]
            for label in np.unique(own).tolist():
                mine = of_label.get(label)
                if mine is None:
                    continue
                these = np.flatnonzero(own == label)
                step = max(1, CELLS // len(mine))
                for part in (these[i:i + step] for i in range(0, len(these), step)):
                    a, b = _padded(anchors[mine], x[part])
                    score = a @ b.T
                    score[names[mine][:, None] == ids[part][None, :]] = -math.inf
                    bar = best.least[mine]
                    if len(part) > k:  # nothing under the k-th of this batch can be chosen
                        bar = np.maximum(bar, np.partition(score, len(part) - k, axis=1)[:, len(part) - k])
                    at, to = np.nonzero((score >= bar[:, None]) & (score > -math.inf))
                    best.add(mine[at], score[at, to].astype(np.int64), ids[part][to])
        yield best.rows(names, 1)

    return rows.mapInArrow(select, _FOUND)


def _other_labels(rows: DataFrame, shared, k: int, low: int, high: int) -> DataFrame:
    """(anchor, slot, score, id): each task's first ``k`` rows of other labels in every slot."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, labels, anchors, limits = shared.value
        width = limits.shape[1] + 1
        best = _Best(len(names) * width, k)
        step = max(1, CELLS // max(1, len(names)))
        for batch in batches:
            good, x = _vectors(batch.column(2))
            ids, own = (batch.column(c).to_numpy(zero_copy_only=False)[good] for c in (0, 1))
            first = _first_copies(ids, own, x, k + 1)
            for part in (first[i:i + step] for i in range(0, len(first), step)):
                a, b = _padded(anchors, x[part])
                score = (a @ b.T).astype(np.int64)
                fits, slot = np.zeros(score.shape, bool), np.zeros(score.shape, np.int32)
                for j in range(limits.shape[1]):  # a limit of each anchor at a time
                    p = limits[:, j:j + 1]
                    under = (100 * score <= high * p) & (p > _NONE)
                    slot += under
                    fits |= under & (100 * score >= low * p)
                fits &= (labels[:, None] != own[part][None, :]) & (names[:, None] != ids[part][None, :])
                at, to = np.nonzero(fits)
                cell, value = at * width + slot[at, to], score[at, to]
                may = value >= best.least[cell]
                best.add(cell[may], value[may], ids[part][to[may]])
        yield best.rows(names, width)

    return rows.mapInArrow(select, _FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    first = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return first.dropDuplicates(["anchor", "slot", "rank"])


def _answers(slots: DataFrame, positives: DataFrame, k: int, m: int, low: int) -> DataFrame:
    """Each positive's first ``k`` rows of its window, from the kept rows of the disjoint slots."""
    lists = slots.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "id"))).alias("first"))
    cells = lists.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "first"))).alias("slots"))
    none = F.array().cast("array<struct<low:bigint,id:bigint>>")
    under, answer = [], none
    for j in range(m, 0, -1):
        # slot j lies above all that follow: its rows come first
        answer = F.slice(F.concat(F.coalesce(F.try_element_at("slots", F.lit(j)), none), answer), 1, k)
        under.append((j, answer))
    joined = positives.join(cells, "anchor").select("anchor", F.col("rank").alias("j"), F.col("id").alias("positive_id"),
                                                    F.col("score").alias("positive_score"), "slots")
    chosen = F.coalesce(*[F.when(F.col("j") == j, a) for j, a in under])
    inside = F.filter(chosen, lambda x: -100 * x["low"] >= low * F.col("positive_score"))
    out = joined.select("anchor", "positive_id", "positive_score", F.posexplode(inside).alias("at", "negative"))
    return out.select(
        F.col("anchor").alias("anchor_id"), "positive_id", (F.col("at") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
        "positive_score", (-F.col("negative.low")).alias("negative_score"))


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` holds for.

    ``label`` is a column of whole numbers; ``low`` and ``high`` are percentages of the positive's score.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
                        F.col(vector).cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    named = named.where("id is not null and label is not null and x is not null")
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < math.inf), F.lit(False)))
    asking = named.where(F.col("asks") & finite).groupBy("id").agg(F.min(F.struct("label", "x")).alias("row"))
    asking = cut(asking.select("id", "row.label", "row.x"))
    blocks = max(1, math.ceil(asking.count() / block))
    others = named.select("id", "label", "x")
    folder = f"{spark.sparkContext.getCheckpointDir()}/hard-negatives-{uuid.uuid4().hex}"
    for number in range(blocks):
        held = asking.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).orderBy("id").toArrow()  # about ``block`` rows
        names, labels = (held.column(c).to_numpy() for c in (0, 1))
        _, x = _vectors(held.column(2))
        shared = spark.sparkContext.broadcast((names, labels, x, None))
        first = cut(_merged(_same_label(others, shared, positives), positives))
        shared.destroy()
        limits = np.full((len(names), positives), _NONE)
        got = first.select("anchor", "rank", "score").toArrow()  # ``positives`` rows an anchor of the block
        limits[np.searchsorted(names, got.column(0).to_numpy()), got.column(1).to_numpy() - 1] = got.column(2).to_numpy()
        shared = spark.sparkContext.broadcast((names, labels, x, limits))
        kept = _merged(_other_labels(others, shared, negatives, low, high), negatives)
        _answers(kept, first, negatives, positives, low).write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.parquet(folder)
