"""Sets of k-mers as sorted 64-bit codes, a batch of sequences at a time.

A code is a one-to-one mix of the k-mer (and its place), so equal tokens have equal codes and
different ones different codes; a sequence shorter than k is one token, coded by a 63-bit digest.
The sets are those of ``seq.kmers`` and ``seq.positional_kmers``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .values import col

#: Letters of sequences that are coded together.
LETTERS = 500_000
#: Longest k-mers whose codes, with a place before them, fit 63 bits.
WIDEST = 15
EPS = 1e-9

_DIGIT = np.full(256, -1, dtype=np.int64)
for _i, _b in enumerate(b"ACGT"):
    _DIGIT[_b] = _i


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded(texts: list[str], k: int, places: bool) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, their codes): the codes of a text are distinct and sorted."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # a line end behind each text makes every window across two of them unknown
    letters = np.frombuffer("".join([t + "\n" for t in texts]).encode("ascii", "replace"), dtype=np.uint8)
    digit = _DIGIT[letters]
    n = max(0, len(digit) - k + 1)
    row = np.repeat(np.arange(len(texts)), lengths + 1)[:n]
    forward, backward, known, usable = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), np.ones(n, bool)
    for at in range(k):
        part = digit[at:at + n]
        forward = forward * 4 + part
        backward += (3 - part) << (2 * at)
        known &= part >= 0
        usable &= (part >= 0) | (letters[at:at + n] == ord("N"))
    if places:
        before = np.r_[0, np.cumsum(usable)]
        start = np.minimum(np.cumsum(lengths + 1) - lengths - 1, n)
        codes = forward + ((before[:-1] - before[start][row]) << (2 * k))
    else:
        codes = np.minimum(forward, backward)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    digests = [-1 - (int.from_bytes(blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest()) >> 1) for i in short]
    row, codes = np.r_[row[known], short], np.r_[codes[known], np.array(digests, np.int64)]
    codes = mixed(codes.view(np.uint64)).view(np.int64)
    order = np.lexsort((codes, row))
    row, codes = row[order], codes[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
    return np.bincount(row[first], minlength=len(texts)), codes[first]


def shares(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in shares of some ``LETTERS`` letters; null is an empty text."""
    texts = [t or "" for t in column.to_pylist()]
    share = np.cumsum([len(t) for t in texts]) // LETTERS
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(share)) + 1):
        if len(rows):
            yield texts[rows[0]:rows[-1] + 1]


def lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def words(counts: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """The 256 bits that the codes of each row set, as four numbers."""
    row = np.repeat(np.arange(len(counts)), counts)
    bits = np.zeros((len(counts), 256), bool)
    bits[row, codes & 255] = True
    return list(np.packbits(bits, axis=1, bitorder="little").view(np.int64).T)


def most_apart(n: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens in which a set of n and one of n or fewer can differ at a Jaccard index of ``threshold``."""
    return np.floor(2 * n * ((1 - threshold) / (1 + threshold)) + EPS).astype(np.int64)


def part_keys(counts: np.ndarray, codes: np.ndarray, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((keys held by each row, keys), (keys asked by each row, keys)), for thresholds above 0.5.

    All tokens are dealt to parts by their codes, and a token in which two sets differ spoils one part. A row
    asks under one part more than tokens can differ between it and a set no larger, its fullest ones, so one of
    them is equal in every such set that is similar. The number of parts is that of the larger row's
    class of sizes, a power of two; a row holds the parts of its class and of the next if a partner may lie there.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    size = np.where(counts > 0, np.int64(1) << np.int64(np.log2(np.maximum(counts, 1))), 0)  # least size of the class
    value, place = mixed(codes.view(np.uint64)), codes.view(np.uint64) >> np.uint64(20)
    held, asked = [], []
    for least in {int(s) for s in size} | {2 * int(s) for s in size}:
        own = (size == least) & (counts > 0)
        inside = own | ((2 * size == least) & (counts >= threshold * least - EPS) & (counts > 0))
        rows = np.flatnonzero(inside)
        if not len(rows):
            continue
        parts = int(most_apart(np.array([2 * least - 1]), threshold)[0]) + 1
        local = np.cumsum(inside) - 1
        taken = inside[row]
        cell = local[row[taken]] * parts + (place[taken] % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(len(rows) * parts, np.uint64)
        np.add.at(sums, cell, value[taken])
        fill = np.bincount(cell, minlength=len(sums)).reshape(len(rows), parts)
        name = mixed(np.arange(parts, dtype=np.uint64) + np.uint64((least << 32) % 2**64))
        keys = mixed(sums.reshape(len(rows), parts) + name).view(np.int64)
        held.append((np.repeat(rows, parts), keys.ravel()))
        fullest = np.argsort(-fill[own[rows]], axis=1, kind="stable")
        wanted = np.arange(parts) <= most_apart(counts[rows[own[rows]]], threshold)[:, None]
        asked.append((np.repeat(rows[own[rows]], parts).reshape(wanted.shape)[wanted], np.take_along_axis(keys[own[rows]], fullest, 1)[wanted]))

    def by_row(found):
        rows, keys = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(2))
        return np.bincount(rows, minlength=len(counts)), keys[np.argsort(rows, kind="stable")]

    return by_row(held), by_row(asked)


@dataclass(frozen=True)
class CodedSets:
    """Token sets of k-mers: called with a column it gives the sorted codes, like other token functions their texts."""

    k: int
    places: bool = False

    def __call__(self, c) -> Column:
        k, places = self.k, self.places

        @F.arrow_udf("array<bigint>")
        def codes(column: pa.Array) -> pa.Array:
            return joined([lists(*coded(t, k, places)) for t in shares(column)], pa.list_(pa.int64()))

        return codes(col(c))

    def digest(self, c) -> Column:
        """One digest for equal sets."""
        k, places = self.k, self.places

        @F.arrow_udf("binary")
        def digests(column: pa.Array) -> pa.Array:
            out = []
            for texts in shares(column):
                counts, codes = coded(texts, k, places)
                out += [sha256(part.tobytes()).digest() for part in np.split(codes, np.cumsum(counts)[:-1])]
            return pa.array(out, pa.binary())

        return digests(col(c))

    def summary(self, c) -> Column:
        """Struct of the sorted codes and the four words of the bitmap."""
        k, places = self.k, self.places

        @F.arrow_udf("hashed array<bigint>, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
        def summaries(column: pa.Array) -> pa.Array:
            names = ["hashed", "w0", "w1", "w2", "w3"]
            out = []
            for texts in shares(column):
                counts, codes = coded(texts, k, places)
                out.append(pa.StructArray.from_arrays([lists(counts, codes), *map(pa.array, words(counts, codes))], names))
            return joined(out, pa.struct([("hashed", pa.list_(pa.int64())), *[(w, pa.int64()) for w in names[1:]]]))

        return summaries(col(c))

    def part_keys(self, c, threshold: float, asked: bool) -> Column:
        """The keys a row holds, or those it asks for; see the function of that name."""
        k, places = self.k, self.places

        @F.arrow_udf("array<bigint>")
        def keys(column: pa.Array) -> pa.Array:
            return joined([lists(*part_keys(*coded(t, k, places), threshold)[asked]) for t in shares(column)], pa.list_(pa.int64()))

        return keys(col(c))
