"""Token counts of whole texts by a two-tier look-up of pre-tokens.

The tokenizer splits a text into pre-tokens (words with the space before them, digit runs,
marks, white space) and encodes each on its own, so a text has as many tokens as its
pre-tokens have together. First tier: the token counts of the ``TABLE`` most frequent
pre-tokens, broadcast as one compact byte table that each worker turns into a hash table
once. Second tier: what the table lacks is encoded by the worker and remembered in a cache
of ``REMEMBERED`` entries. No pre-token is shuffled: documents are counted where they lie.

The table only saves work; a pre-token has the same count in either tier. It is therefore
drawn from a bounded number of documents (about ``SAMPLE``, any row with the same chance), which
a few tasks split and count. Each of them returns one row of at most ``TABLE`` entries.

Exactness. Special tokens are looked for first, as the library does, and count one each.
Texts that hold a character outside the blocks of ``PLAIN``, where the split pattern's
character classes could differ between Unicode versions, go to the library whole.

Defined results. Null is the empty text: no bytes, no tokens. Repeated rows and null ids
each get their row. Very long pre-tokens are encoded but not remembered. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..session import spread

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Entries of the broadcast table, and the longest pre-token in it, in characters: at most some 3 MB.
TABLE, LONGEST = 50_000, 24
#: Documents whose pre-tokens are counted for the table, and the tasks that count them.
SAMPLE, SAMPLERS = 4096, 8
#: Entries in each of a worker's two memories; a full one replaces the older, so frequent ones survive.
REMEMBERED = 250_000

# Fixed value: the pattern by which the byte-level vocabulary splits a text.
_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Blocks whose characters have had the same classes in all Unicode versions since 3.2.
PLAIN = (r"\x00-ȠΑ-ΡΣ-ώЀ-ҁҌ-ӄא-ת‐-‧‰-⁆₠-€"
         r"、-〜ぁ-ゔァ-ヺ一-龥가-힣！-～")
_STRANGE = regex.compile(f"[^{PLAIN}]")

_workers: dict[tuple, TokenCounter] = {}


class TokenCounter:
    """Numbers of tokens of whole texts, with a table of frequent pre-tokens and a memory of others."""

    def __init__(self, path: str, table: dict[str, int] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the model reads bytes as letters: printable ones as they are, the others from U+0100 on
        plain, spare = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
        self.letters = {b: b if b in plain else next(spare) for b in range(256)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent = table or {}
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.missed = 0

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encoded_piece(self, piece: str) -> int:
        """Tokens of one pre-token: it goes to the BPE model without the library's own splitting."""
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def _rare(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.older.get(piece)
            if n is None:
                self.missed += 1
                n = self.encoded_piece(piece)
            if len(piece) <= 4 * LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or _STRANGE.search(text):
            return self.encoded(text)
        pieces = _SPLIT.findall(text)
        found = list(map(self.frequent.get, pieces))
        if None in found:
            return sum(self._rare(p) if n is None else n for p, n in zip(pieces, found))
        return sum(found)


def packed(table: dict[str, int]) -> bytes:
    """The table as bytes: the count and the length of each pre-token, then the pre-tokens."""
    keys = [k.encode() for k in table]
    return b"".join([len(keys).to_bytes(4, "little"), bytes(table.values()), bytes(map(len, keys)), *keys])


def unpacked(data: bytes) -> dict[str, int]:
    n = int.from_bytes(data[:4], "little")
    counts, lengths, at, out = data[4:4 + n], data[4 + n:4 + 2 * n], 4 + 2 * n, {}
    for count, length in zip(counts, lengths):
        out[data[at:at + length].decode()] = count
        at += length
    return out


def frequent(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample of documents."""
    rows = docs.count()
    if not rows:
        return {}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and not _STRANGE.search(t):
                    counts.update(p for p in _SPLIT.findall(t) if len(p) <= LONGEST)
                if len(counts) > 20 * TABLE:
                    counts = Counter(dict(counts.most_common(2 * TABLE)))
        top = counts.most_common(TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([[p for p, _ in top]], pa.list_(pa.string())),
                                          pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["pieces", "counts"])

    # every row has the same chance, so about SAMPLE documents are split however large the table
    sample = docs.select(F.col(text).cast("string").alias("text")).sample(min(1.0, SAMPLE / rows), 42).repartition(SAMPLERS)
    total: Counter[str] = Counter()
    for r in sample.mapInArrow(tally, "pieces array<string>, counts array<bigint>").toLocalIterator():
        total.update(dict(zip(r["pieces"], r["counts"])))
    counter = TokenCounter(path)
    return {p: counter.encoded_piece(p) for p, _ in total.most_common(TABLE)}


def _counter(path: str, shared) -> TokenCounter:
    key = (path, shared.value)
    if key not in _workers:
        _workers.clear()
        _workers[key] = TokenCounter(path, unpacked(shared.value))
    return _workers[key]


def token_counts(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    ``vocabulary`` is the path of a byte-level tokenizer file; by default that of the installed public one.
    """
    path = vocabulary or str(public_tokenizers.path(VOCABULARY))
    shared = docs.sparkSession.sparkContext.broadcast(packed(frequent(docs, path, text)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, shared)
        for batch in batches:
            n = list(map(counter.count, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    narrow = spread(docs.select(id_col, text)).select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(text).cast("string").alias("text"))
    counted = narrow.mapInArrow(count, "id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
