"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint holds one bit per column of the XXH64 values of its 3-word
shingles (set in more than half of them). Two fingerprints link at ``RADIUS`` or fewer
differing bits; groups are the connected components of the links.

Candidates. 64 bits are cut into four blocks; two fingerprints within two bits agree in
two whole blocks, so every linked pair meets under one of six 32-bit keys. Keys held by
one fingerprint vanish in a count. A crowded key is cut again: the other 32 bits fall
into four blocks of which two must agree, which leaves 16 free bits, so no bucket ever
holds more than 65,536 distinct fingerprints. No key, pair or bucket is dropped.

Comparison. A bucket is stored vertically: plane b has bit b of 64 fingerprints in one
machine word. A query is compared with 64 fingerprints at a time: each plane is XORed
with the query's bit and added to carry-save counters (ones, twos, overflow); a block of
lanes is abandoned as soon as all its distances exceed the radius. Each bucket returns a
spanning forest of its links, never all pairs of a group.

Defined results. A null or empty text, or one without words, has fingerprint zero and
links like any other; fewer words than a shingle make one shingle of all words. Equal
fingerprints are one vertex, whatever their number, so a group of copies costs one
comparison. Repeated rows each get their row. A null id is ignored when the smallest id
of a group is taken; a group of null ids only has a null component. Extra columns are
ignored by ``signatures`` and kept by ``keep_one``. Empty tables give empty tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.components import contract
from ..session import cut

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints a first-level key may hold before it is cut again; a plan choice, never a cap.
CROWDED = 4096
#: Rows compared together; small buckets share a block (a link between buckets is a true link).
BLOCK = 512
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())),
                         np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        octets = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(sign, "id bigint, fp bigint")


def close_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the links within distinct ``prints`` (uint64), by bit slices."""
    rows, lanes = len(prints), -(-len(prints) // 64)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    order = [b for b in np.argsort(-np.minimum(ones, rows - ones)) if 0 < ones[b] < rows]  # telling planes first
    padded = np.zeros((64, lanes * 64), np.uint8)
    padded[:, :rows] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    last = np.zeros(lanes * 64, np.uint8)
    last[:rows] = 1
    used = np.packbits(last, bitorder="little").view("<u8")
    parent = list(range(rows))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, min(rows, (1 << 18) // lanes))
    for at in range(0, rows, step):
        own = bits[at:at + step]
        first = at // 64  # pairs are symmetric: only lanes from the query's own on
        open_lanes = np.arange(first, lanes)
        c0, c1, far = (np.zeros((len(own), lanes - first), np.uint64) for _ in range(3))
        far |= ~used[first:]
        for n, b in enumerate(order):
            x = planes[b][open_lanes] ^ np.where(own[:, b], _ONES, np.uint64(0))[:, None]
            carry = c0 & x
            c0 ^= x
            far |= c1 & carry
            c1 ^= carry
            if radius == 2:
                far |= c0 & c1
            if n % 4 == 3:
                alive = ~(far == _ONES).all(axis=0)
                if not alive.any():
                    break
                if alive.sum() * 2 < len(alive):
                    open_lanes, c0, c1, far = open_lanes[alive], c0[:, alive], c1[:, alive], far[:, alive]
        near = ~far
        for i, j in zip(*np.nonzero(near)):
            word = int(near[i, j])
            while word:
                low = word & -word
                a, b = root(at + int(i)), root(int(open_lanes[j]) * 64 + low.bit_length() - 1)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                word ^= low
    return [(root(i), i) for i in range(rows) if root(i) != i]


def _keys(bits: F.Column, width: int) -> F.Column:
    """Array of the six keys made of two of the four blocks of ``width`` bits each."""
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned(bits, width * k).bitwiseAND(F.lit(mask).cast("bigint")) for k in range(4)]
    return F.array(*[
        F.shiftleft(F.lit(n).cast("bigint"), 2 * width).bitwiseOR(F.shiftleft(block[b], width)).bitwiseOR(block[a])
        for n, (a, b) in enumerate(itertools.combinations(range(4), 2))])


def _rest(fp: F.Column, key: F.Column) -> F.Column:
    """The 32 bits that the first-level ``key`` leaves free."""
    mask = F.lit(0xFFFF).cast("bigint")
    block = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(mask) for k in range(4)]
    pair, out = F.shiftrightunsigned(key, 32), F.lit(None).cast("bigint")
    for n, chosen in enumerate(itertools.combinations(range(4), 2)):
        low, high = [k for k in range(4) if k not in chosen]
        out = F.when(pair == n, F.shiftleft(block[high], 16).bitwiseOR(block[low])).otherwise(out)
    return out


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column ``fp``) that connect every group."""
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), 16)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(counts, "key")
    again = F.when(F.col("n") > crowded, _keys(_rest(F.col("fp"), F.col("key")), 8)).otherwise(
        F.array(F.lit(-1).cast("bigint")))
    buckets = met.select("key", F.explode(again).alias("sub"), "fp")
    dealt = buckets.repartition("key", "sub").sortWithinPartitions("key", "sub")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src", "dst"]

        def linked(parts: list[np.ndarray]) -> pa.RecordBatch:
            block = np.unique(np.concatenate(parts))
            pairs = np.array(close_links(block.view(np.uint64)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(block[pairs[:, 0]]), pa.array(block[pairs[:, 1]])], names)

        whole: list[np.ndarray] = []  # complete buckets waiting for a block
        part: list[np.ndarray] = []  # the bucket being read
        held, current = 0, None
        for batch in batches:
            key, sub, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(fp):
                continue
            edges = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            bounds = [0, *edges.tolist(), len(fp)]
            for a, b in zip(bounds, bounds[1:]):
                name = (key[a], sub[a])
                if current is not None and name != current:
                    whole += part
                    held += sum(map(len, part))
                    part = []
                    if held >= BLOCK:
                        yield linked(whole)
                        whole, held = [], 0
                current = name
                part.append(fp[a:b].copy())
        if whole or part:
            yield linked(whole + part)

    return dealt.mapInArrow(compare, "src bigint, dst bigint")


def components(signed: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``signed`` (id, fp) plus ``component_id``: the smallest id reachable over links."""
    prints = cut(signed.groupBy("fp").agg(F.min("id").alias("least")))
    roots = contract(links(prints, crowded))
    linked = prints.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.join(linked.select("fp", "root").join(least, "root"), "fp").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``."""
    return components(cut(signatures(docs, id_col, text)), crowded)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: the one with the smallest id. Rows without an id take no part and stay.

    Rows that repeat the surviving id are one document; the first in column order stays.
    """
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text)
    chosen = groups.where("id = component_id").select(F.col("id").alias(id_col)).distinct()
    order = [F.col(f"`{c}`") for c in docs.columns if c != id_col and not dict(docs.dtypes)[c].startswith("map")]
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(*(order or [F.col(id_col)])))
    kept = docs.join(chosen, id_col, "left_semi").select("*", place.alias("__place")).where("__place = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
