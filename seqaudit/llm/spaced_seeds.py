"""Benchmark decontamination by spaced-seed hashing.

Words (runs of letters, digits and underscores, lower case) of benchmark items and of
documents are hashed at the selected positions of fixed masks; the other positions are
ignored, so a substituted word there does not hide the hit. Equal hashes join the two
sides; around every hit the whole diagonal of (document, item) is verified: an overlap
counts if some ``SPAN`` consecutive words agree in at least ``AGREE`` places. The masks
hit every such stretch with up to SPAN - AGREE = 2 substitutions (a test runs through all
cases), so nothing that verification would accept is lost.

Scale. The benchmark is read in blocks of a proven size (``block_chars`` characters; the
sizes are checked before anything is collected) and each block is broadcast; a larger
benchmark means more passes, never a larger broadcast. Documents are not shuffled. The
hash table is joined inside each task, behind a bitmap.

Defined results. A null or empty text on either side has no words and never overlaps.
Items of fewer than ``SPAN`` words match only as a whole, without substitution; items of
fewer than ``LEAST`` words are ignored, as chance would match them. Repeated documents
and items give a row each. An empty benchmark leaves every document clean. Extra columns,
whatever their names, are kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPAN = 13
AGREE = 11
LEAST = 8
#: Selected positions of each mask.
MASKS = ((0, 1, 2, 4, 6, 10), (0, 1, 4, 5, 6, 7))
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
_CHUNK = 400_000
_BITS = 22


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Index:
    """Seed table of one benchmark block; ``places`` are (item, position) in hash order."""

    items: list[tuple[int | None, np.ndarray]]
    ids: dict[str, int]
    hashes: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    bitmaps: list[np.ndarray] = field(default_factory=list)
    short: dict[int, list[int]] = field(default_factory=dict)


def _seeds(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose selected words are all known, and their hashes."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    good = known[:n].copy()
    for p in mask[1:]:
        good &= known[p:p + n]
    at = np.flatnonzero(good)
    out = np.zeros(len(at), np.uint64)
    for p in mask:
        out = (out ^ ids[at + p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return at, out


def build_index(rows: list[tuple[int | None, str | None]]) -> Index:
    ids: dict[str, int] = {}
    items = []
    for item, text in rows:
        tokens = words(text)
        if len(tokens) >= LEAST:
            items.append((item, np.array([ids.setdefault(w, len(ids) + 1) for w in tokens], np.int64)))
    index = Index(items, ids)
    for mask in MASKS:
        found = [(_seeds(a, mask), k) for k, (_, a) in enumerate(items) if len(a) >= SPAN]
        hashes = np.concatenate([h for (_, h), _ in found]) if found else np.zeros(0, np.uint64)
        places = np.array([(k, p) for (at, _), k in found for p in at.tolist()], np.int64).reshape(-1, 2)
        order = np.argsort(hashes, kind="stable")
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        index.hashes.append(hashes[order])
        index.places.append(places[order])
        index.bitmaps.append(bitmap)
    for k, (_, a) in enumerate(items):
        if len(a) < SPAN:  # found by the first word and its neighbours, compared as a whole
            index.short.setdefault(int(a[0]), []).append(k)
    return index


def _verified(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start, words, agreeing) of the overlap where document word shift + k meets item word k."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high - low < SPAN:
        return None
    same = (doc[shift + low:shift + high] == item[low:high]).astype(np.int64)
    sums = np.cumsum(np.concatenate([[0], same]))
    good = np.flatnonzero(sums[SPAN:] - sums[:-SPAN] >= AGREE)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + SPAN
    return shift + low + first, last - first, int(sums[last] - sums[first])


def scan(texts: list[str | None], index: Index) -> list[dict[int, tuple[int, int, int]]]:
    """Per text: item number -> (start word, words, agreeing words) of its longest overlap."""
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    if not index.items:
        return found
    get = index.ids.get

    def flush(group: list[tuple[int, np.ndarray]]) -> None:
        gap = np.zeros(SPAN + 1, np.int64)
        flat = np.concatenate([x for _, ids in group for x in (ids, gap)])
        starts = np.cumsum([0, *[len(ids) + len(gap) for _, ids in group]])
        seen: set[tuple[int, int, int]] = set()
        for mask, hashes, places, bitmap in zip(MASKS, index.hashes, index.places, index.bitmaps):
            if not len(hashes):
                continue
            at, h = _seeds(flat, mask)
            maybe = bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = right > left
            docs = np.searchsorted(starts, at[hit], "right") - 1
            for a, g, lo, hi in zip(at[hit].tolist(), docs.tolist(), left[hit].tolist(), right[hit].tolist()):
                for item, place in places[lo:hi].tolist():
                    seen.add((g, item, a - int(starts[g]) - place))
        for g, item, shift in seen:
            row, ids = group[g]
            best = _verified(ids, index.items[item][1], shift)
            if best and (item not in found[row] or (best[1], best[2], -best[0]) > (
                    found[row][item][1], found[row][item][2], -found[row][item][0])):
                found[row][item] = best
        for row, ids in group if index.short else []:
            for word, numbers in index.short.items():
                for p in np.flatnonzero(ids == word).tolist():
                    for item in numbers:
                        whole = index.items[item][1]
                        if item not in found[row] and np.array_equal(ids[p:p + len(whole)], whole):
                            found[row][item] = (p, len(whole), len(whole))

    group: list[tuple[int, np.ndarray]] = []
    held = 0
    for row, text in enumerate(texts):
        tokens = words(text)
        if len(tokens) < LEAST:
            continue
        group.append((row, np.fromiter((get(w, 0) for w in tokens), np.int64, len(tokens))))
        held += len(tokens)
        if held >= _CHUNK:
            flush(group)
            group, held = [], 0
    if group:
        flush(group)
    return found


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[Index]:
    """Indexes of the benchmark, a block of checked size at a time; an item above the size has its own block."""
    rows = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.length("text") > 0)
    count, chars, longest = rows.agg(F.count(F.lit(1)), F.sum(F.length("text")), F.max(F.length("text"))).first()
    n = max(1, -(-(chars or 0) // block_chars)) if count else 0
    block = lambda: F.pmod(F.xxhash64("item", "text"), F.lit(n))
    while n > 1:
        most = rows.groupBy(block().alias("b")).agg(F.sum(F.length("text")).alias("s")).agg(F.max("s")).first()[0]
        if most <= 2 * max(block_chars, longest) or n >= 4 * count:
            break
        n *= 2
    for k in range(n):
        yield build_index([tuple(r) for r in rows.where(block() == k).collect()])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
             item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_agreeing): the longest overlap of each document and item."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, n_agreeing bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in benchmark_blocks(benchmark, item_col, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for doc, hits in zip(ids, scan(batch.column(1).to_pylist(), shared.value)):
                    rows += [(doc, shared.value.items[k][0], *where) for k, where in hits.items()]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["doc_id", "item_id", "start_word", "n_words", "n_agreeing"])

        out = out.unionByName(narrow.mapInArrow(find, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id",
          item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without an overlap, unchanged."""
    out, schema = docs, docs.schema
    for index in benchmark_blocks(benchmark, item_col, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def drop(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).cast(pa.string()).to_pylist()
                yield batch.filter(pa.array([not hits for hits in scan(texts, shared.value)], pa.bool_()))

        out = out.mapInArrow(drop, schema)
    return out
