"""Packing of tokenised documents into sequences by swap-based local search.

Tokens. A document is the ids of a public tokenizer plus an end mark. Documents longer
than a sequence are cut into full pieces and a rest; nothing else is cut. Words between
ASCII white space are tokenised once per worker and remembered (the tokenizer drops white
space and never merges across it), so a text costs one look-up per word. Only lengths and
a checksum of each piece leave the task.

Bins. Full pieces are sequences of their own. The others are dealt at random to shards
of about ``SHARD`` pieces; each shard starts from a best-fit packing and improves it:
documents are moved, exchanged one for one or two for one between underfull bins
whenever the squared fill grows, so full bins fill up and others run empty and vanish.
A shard ends with about one underfull bin, that is one in some thousands.

Defined results. A null or empty text is a document with the end mark alone. A repeated
row is another document and is packed again; ties are broken by row order within a shard.
Null ids are carried along. Extra columns are ignored. An empty table has no pieces.
Sequence ids are unique, not dense; offsets leave no gap.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..session import cut

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces packed together in one task: a working size, about 40 bytes each.
SHARD = 25_000
#: Words in each of a worker's two memories; a full one replaces the older, so frequent words survive.
REMEMBERED = 250_000
#: Exchanges looked at per bin before it is left as it is.
PARTNERS = 64

_workers: dict[str, WordCoder] = {}


class WordCoder:
    """Ids of whole texts, as little-endian 32-bit words, with a memory of words.

    Words are taken in lower case, as the tokenizer would; words that hold ``<|``, which may
    start a special token, are left as they are. A word of letters alone is one unit of the
    tokenizer's BPE model and goes to it directly; all others take the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # the model reads bytes as letters: printable ones as they are, the others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(spare) for b in range(256)}

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        low = text.lower()
        if low.isalpha() and (low.isascii() or (
                len(low) == len(text) and not set("σςı") & set(low) and unicodedata.is_normalized("NFC", low))):
            ids = [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        split = [self._words((t or "").encode("utf-8", "replace")) for t in texts]
        got = [list(map(self.known.get, words)) for words in split]
        lack = [k for k, found in enumerate(got) if None in found]
        new = {w for k in lack for w, known in zip(split[k], got[k]) if known is None}
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {}
            new = set().union(*split)
            lack = list(range(len(split)))
        for w in new:
            self.known[w] = self.older.get(w) or self._code(w)
        for k in lack:
            got[k] = list(map(self.known.__getitem__, split[k]))
        for found in got:
            yield b"".join(found)

    @staticmethod
    def _words(raw: bytes) -> list[bytes]:
        # ASCII white space only: other spaces stay inside a word and are left to the tokenizer
        if b"<|" in raw:
            return [w if b"<|" in w else w.lower() for w in raw.split()]
        return raw.lower().split()

    def _code(self, word: bytes) -> bytes:
        core = word.rstrip(b".,;:!?*#$%&")
        # after an ASCII letter or digit such marks are a token run of their own
        if core == word or not core[-1:].isalnum() or b"'" in word or b"<|" in word:
            return self._ids(word)
        out = b""
        for part in (core, word[len(core):]):
            coded = self.known.get(part) or self.older.get(part)
            if coded is None:
                coded = self.known[part] = self._ids(part)
            out += coded
        return out


def _coder(path: str) -> WordCoder:
    if path not in _workers:
        _workers[path] = WordCoder(path)
    return _workers[path]


def _runs(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """Texts in order, some million characters at a time."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t or "")
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document.

    ``vocabulary`` is the path of a tokenizer file; by default that of the installed public one.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    end = np.array([END], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary or str(public_tokenizers.path(VOCABULARY)))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at, rows = 0, []
            for run in _runs(batch.column(1).to_pylist()):
                for data in coder.encode(run):
                    data += end
                    for k, a in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[a:a + 4 * capacity]
                        rows.append((ids[at], k, a // 4, len(part) // 4, zlib.crc32(part)))
                    at += 1
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(tokenise, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bisect_left(room, (lengths[k], -1))
        if at == len(room):
            bins.append([])
            free, b = capacity, len(bins) - 1
        else:
            free, b = room.pop(at)
        bins[b].append(k)
        if free > lengths[k]:
            insort(room, (free - lengths[k], b))
    return bins


class _Search:
    """Local search over the underfull bins of one packing; raises the sum of squared fills."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [b for b in bins if b]
        self.fill = [sum(lengths[k] for k in b) for b in self.bins]

    def run(self) -> list[list[int]]:
        least = -(-sum(self.fill) // self.capacity)  # no packing has fewer bins
        moved = True
        while moved and sum(map(bool, self.fill)) > least:
            moved = False
            # the fuller bins take from the emptier ones, starting with the emptiest
            loose = sorted((k for k, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda k: -self.fill[k])
            for at, taker in enumerate(loose):
                for giver in reversed(loose[max(at + 1, len(loose) - PARTNERS):]):
                    while self.fill[giver] and self.fill[taker] < self.capacity and self.fill[taker] >= self.fill[giver] \
                            and self._better(taker, giver):
                        moved = True
                    if self.fill[taker] == self.capacity:
                        break
        return [b for b in self.bins if b]

    def _better(self, taker: int, giver: int) -> bool:
        """Apply the best move or exchange that fills ``taker`` from ``giver``; False if there is none.

        The taker is at least as full, so any gain it can hold raises the squared fill.
        """
        free, size = self.capacity - self.fill[taker], self.lengths
        mine, theirs = self.bins[taker], self.bins[giver]
        best: tuple[int, list[int], list[int]] = (0, [], [])
        by_size = sorted((size[k], k) for k in theirs)

        def largest(most: int, skip: int = -1) -> tuple[int, int] | None:
            at = bisect_left(by_size, (most + 1, -1)) - 1
            while at >= 0 and by_size[at][1] == skip:
                at -= 1
            return by_size[at] if at >= 0 else None

        def offer(out: list[int], into: list[int]) -> None:
            nonlocal best
            gain = sum(size[k] for k in into) - sum(size[k] for k in out)
            if best[0] < gain <= free:
                best = (gain, out, into)

        if found := largest(free):  # move
            offer([], [found[1]])
        for a in mine:
            if best[0] == free:
                break
            if found := largest(free + size[a]):  # one for one
                offer([a], [found[1]])
            for length, k in by_size[:PARTNERS]:  # two of theirs for one of mine
                if (rest := largest(free + size[a] - length, k)) and length < free + size[a]:
                    offer([a], [k, rest[1]])
        for i, a in enumerate(mine[:PARTNERS]):  # one of theirs for two of mine
            for b in mine[i + 1:PARTNERS]:
                if best[0] < free and (found := largest(free + size[a] + size[b])):
                    offer([a, b], [found[1]])
        gain, out, into = best
        if not gain:
            return False
        self.bins[taker] = [k for k in mine if k not in out] + into
        self.bins[giver] = [k for k in theirs if k not in into] + out
        self.fill[taker] += gain
        self.fill[giver] -= gain
        return True


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers for lengths of at most ``capacity``."""
    return _Search(best_fit(lengths, capacity), lengths, capacity).run()


def plan(cut_pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``. The input should be materialised: it is counted first."""
    loose = cut_pieces.where(F.col("length") < capacity)
    shards = max(1, -(-loose.count() // shard))
    schema = cut_pieces.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema
    order = ["length", "doc_id", "piece", "start", "ids_crc32"]

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, ignore_index=True)
        lengths = group["length"].tolist()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for number, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for k in members:
                sequence[k], offset[k] = number, at
                at += lengths[k]
        # even ids: shard and bin; odd ids are the full pieces
        return group.drop(columns="shard").assign(sequence_id=2 * ((int(key[0]) << 32) + sequence), offset=offset)

    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length", F.rand(7)), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(fill, schema)
    full = cut_pieces.where(F.col("length") >= capacity).select(
        "*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(full)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         vocabulary: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece of every document: where it starts, its checksum and its place in a sequence."""
    return plan(cut(pieces(docs, id_col, text, capacity, vocabulary)), capacity, shard)
