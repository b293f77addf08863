"""Near copies by word shingles: every pair at Jaccard ``SIMILARITY`` or more, verified exactly.

A text is the set of its 5-word shingles (64-bit hashes of lower-case words). Candidates
meet under one of ``BANDS`` MinHash keys of ``ROWS`` values each; a pair at Jaccard s meets
with probability 1 - (1 - s^ROWS)^BANDS (0.9999 at 0.8). A 64-bit SimHash cannot do this:
at Jaccard 0.8 about 10 of 64 bits differ, and keys that survive 16 differing bits hold
three bits each.

Whoever meets is compared by sketches (one byte of each MinHash value) and, unless these
are far apart, by the whole shingle sets; groups are the connected components of the
verified links. The first pass looks at a few keys: a text meets one hub per key, and only
the nearest of them is verified, so a group of copies costs one set comparison a text,
whatever its size. What shares any key but no component after that is compared in full:
the largest component of a key does not probe, and crowded keys are cut into blocks of probing
rows and of members. Where a block has few candidates for its rows they are verified pair by pair; where
most rows are alike, but not enough, the block's rows are brought together once with their sets,
every pair is counted there by an inverted index, and only links that join components
leave the task. So what is moved grows with rows, not with pairs. No key, pair or bucket is dropped.

Defined results. Texts of equal words are one vertex. Null, empty and wordless texts are
equal; fewer words than a shingle make one shingle of all words. Rows without an id take no
part and stay. Repeated rows, ties and empty tables are handled as in ``sliced_simhash``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.components import contract
from ..session import cut

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Keys the hub pass looks at, and candidates a row of a block above which the block is verified as a whole; plan choices, never caps.
KEYS, DENSE = 6, 4
#: Equal sketch bytes (of 120) below which a pair is not fetched; the mean at 0.8 is 96, the deviation 4.4.
SKETCH_LEAST = 76
#: Rows of a crowded key that probe together, and members they are compared with.
PROBES, MEMBERS = 1024, 4096
#: Keys whose layout every task gets (24 bytes each); above that they are joined.
SHARED_KEYS = 500_000
SEED = 42
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_ODD = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


class _WordHashes(dict):
    """Hash per word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out


def shingles(words: list[bytes], hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(each) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ each[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhashes(found: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima over the shingles, each under its own order."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    narrow = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(narrow), 2048):
        out = np.minimum(out, ((narrow[at:at + 2048][None, :] ^ _XOR) * _ODD).min(axis=1))
    return out


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, v, bands, sketch) per row; v stands for the words of the text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            digests, bands, sketches = [], [], []
            for t in batch.column(1).to_pylist():
                words = _words(t)
                low = minhashes(shingles(words, hashes))
                digests.append(_digest(words))
                rows = low.astype("<u4").reshape(BANDS, ROWS)
                bands.append([xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)])
                sketches.append((low & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["id", "v", "bands", "sketch"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(sign, "id bigint, v binary, bands array<bigint>, sketch binary")


def _estimated(pairs: DataFrame) -> DataFrame:
    """``pairs`` (n, w, sketch, other) with the number of equal sketch bytes, if large enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
            same = (a == b).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], ["n", "w", "same"])
            yield out.filter(pa.array(same >= SKETCH_LEAST))

    return pairs.select("n", "w", "sketch", "other").mapInArrow(compare, "n bigint, w bigint, same bigint")


def _sets(wanted: DataFrame, docs: DataFrame, vertices: DataFrame, text: str, id_col: str) -> DataFrame:
    """(n, set): the sorted shingle hashes of the wanted texts (n), written."""
    needed = cut(vertices.join(wanted.distinct(), "n", "left_semi").select("n", "v", "least"))
    ids = needed.select(F.col("least").alias("id")).distinct()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            split = [_words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(_digest, split)), pa.binary()),
                 pa.array([shingles(w, hashes).astype("<u8").tobytes() for w in split], pa.binary())], ["v", "set"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    sets = narrow.join(ids, "id", "left_semi").select("text").mapInArrow(spell, "v binary, set binary")
    return cut(sets.join(needed.select("n", "v"), "v").select("n", "set").dropDuplicates(["n"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst): the ``pairs`` (n, w) whose shingle sets have Jaccard ``SIMILARITY`` or more."""
    both = pairs.join(sets, "n").join(sets.select(F.col("n").alias("w"), F.col("set").alias("other")), "w")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), "<u8") for x in (a, b))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good.append(shared >= SIMILARITY * (len(a) + len(b) - shared) - 1e-9)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"])
            yield out.filter(pa.array(good, pa.bool_()))

    return cut(both.select("n", "w", "set", "other").mapInArrow(check, "src bigint, dst bigint"))


def joining_links(names: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links at ``SIMILARITY`` between the rows of a block that join its components; every pair of components is compared."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, count = np.unique(np.concatenate(sets) if len(owner) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(inverse, kind="stable")]
    first, start = np.cumsum(count) - count, np.cumsum(sizes) - sizes
    up: dict[int, int] = {}

    def find(r: int) -> int:
        while r in up:
            r = up[r]
        return r

    most = max(set(roots), key=roots.count)
    out = []
    for k, root in enumerate(roots):
        if root == most:
            continue  # two rows of the largest component need no link; the others look at all
        shared, tokens = np.zeros(len(sets), np.int64), inverse[start[k]:start[k] + sizes[k]]
        total = np.cumsum(count[tokens])
        for part in np.split(tokens, np.flatnonzero(np.diff(total // 4_000_000)) + 1):
            n = count[part]
            at = np.arange(n.sum()) + np.repeat(first[part] - np.cumsum(n) + n, n)
            shared += np.bincount(holders[at], minlength=len(sets))
        for j in np.flatnonzero(shared >= SIMILARITY * (sizes + sizes[k] - shared) - 1e-9).tolist():
            a, b = find(root), find(roots[j])
            if a != b:
                up[a] = b
                out.append((names[k], names[j]))
    return out


def _verified_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst): the links that join the components of each block of ``rows`` (n, root, key, probe, part)."""
    dealt = rows.join(sets, "n").select("key", "probe", "part", "n", "root", "set").repartition(
        "key", "probe", "part").sortWithinPartitions("key", "probe", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches):
            found = joining_links([r[0] for r in block], [r[1] for r in block], [np.frombuffer(r[2], "<u8") for r in block])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["src", "dst"])

    return cut(dealt.mapInArrow(compare, "src bigint, dst bigint").distinct())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows behind the first three columns, block by block: at most some PROBES + MEMBERS rows."""
    held: list[tuple] = []
    current = None
    for batch in batches:
        for key, probe, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, probe, part) != current:
                if held:
                    yield held
                held, current = [], (key, probe, part)
            held.append(tuple(row))
    if held:
        yield held


def _labelled(vertices: DataFrame, links: DataFrame) -> DataFrame:
    roots = contract(links).withColumnRenamed("id", "n")
    return vertices.join(roots, "n", "left").withColumn("root", F.coalesce("component", "n")).drop("component")


def _hub_pairs(own: DataFrame) -> DataFrame:
    """(n, w): each text and the nearest hub among those of its first keys."""
    keyed = own.select("n", F.explode(F.slice("bands", 1, KEYS)).alias("key"))
    # one order of all texts for all keys: a group of copies has few hubs
    hub = F.min(F.struct(F.xxhash64("n").alias("o"), F.col("n").alias("w")))
    hubs = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), hub.alias("hub")).where("held > 1").select(F.col("key").alias("at"), "hub.w")
    meets = keyed.join(hubs, (F.col("key") == F.col("at")) & (F.col("n") != F.col("w"))).select("n", "w").distinct()
    sketch = own.select("n", "sketch")
    near = _estimated(meets.join(sketch, "n").join(sketch.select(F.col("n").alias("w"), F.col("sketch").alias("other")), "w"))
    return near.groupBy("n").agg(F.max_by("w", F.struct("same", "w")).alias("w"))


_PLACED = "key bigint, probe int, part int, n bigint, root bigint, asks boolean, sketch binary"


def _layout(labelled: DataFrame) -> DataFrame:
    """(key, big, probes, parts): the keys with two components or more, the largest, and the blocks their rows are dealt to."""
    counts = labelled.select("root", F.explode("bands").alias("key")).groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    keys = counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("held"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    return cut(keys.select("key", F.col("m.root").alias("big"), blocks(F.col("held") - F.col("m.c"), PROBES).alias("probes"),
                           blocks(F.col("held"), MEMBERS).alias("parts")))


def _deal(n: int, root: int, sketch: bytes, key: int, big: int, probes: int, parts: int) -> Iterator[tuple]:
    """Places of one row of a key: with the block of members it probes, and with the probes it answers."""
    asks, home = root != big, hash(n) % parts
    if probes == parts == 1:
        yield key, 0, 0, n, root, asks, sketch
        return
    own = hash(n ^ 0x5BD1E995) % probes
    for block in range(probes):
        if not (asks and block == own):
            yield key, block, home, n, root, False, sketch
    for part in range(parts) if asks else ():
        yield key, own, part, n, root, True, sketch


def _placed(labelled: DataFrame, layout: DataFrame) -> DataFrame:
    """The rows of the keys in ``layout``, dealt to blocks."""
    width = layout.count()
    if width > SHARED_KEYS:
        rows = labelled.select("n", "root", "sketch", F.explode("bands").alias("key")).join(layout, "key")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _rows(x for row in zip(*(c.to_pylist() for c in batch.columns)) for x in _deal(*row))

        return rows.select("n", "root", "sketch", "key", "big", "probes", "parts").mapInArrow(deal, _PLACED)
    held = layout.orderBy("key").toArrow()
    shared = labelled.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("key", "big", "probes", "parts")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *rest = shared.value
        for batch in batches:
            names, roots, sketches = (batch.column(c).to_pylist() for c in (0, 1, 2))
            own = np.asarray(batch.column(3).flatten())
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            hits = np.flatnonzero(keys[at] == own) if len(keys) else np.zeros(0, int)
            table = zip(hits.tolist(), keys[at[hits]].tolist(), *(c[at[hits]].tolist() for c in rest))
            yield _rows(x for h, *cells in table for x in _deal(names[h // BANDS], roots[h // BANDS], sketches[h // BANDS], *cells))

    return labelled.select("n", "root", "sketch", "bands").mapInArrow(find, _PLACED)


def _rows(places: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*places)) or [()] * 7
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    names = ["key", "probe", "part", "n", "root", "asks", "sketch"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _across(placed: DataFrame) -> DataFrame:
    """Rows of one key in different components whose sketches are close.

    (n, w) for a pair; or, where a block has many for its rows, each row of them as (n, root, key, probe, part).
    """
    dealt = placed.repartition("key", "probe", "part").sortWithinPartitions("key", "probe", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches):
            names, roots, asks = (np.array([r[k] for r in block]) for k in (0, 1, 2))
            sketch = np.frombuffer(b"".join(r[3] for r in block), np.uint8).reshape(-1, BANDS * ROWS)
            left, right, met, dense = [], [], np.zeros(len(block), bool), False
            for k in np.flatnonzero(asks):
                other = np.flatnonzero(roots != roots[k])
                near = other[(sketch[other] == sketch[k]).sum(axis=1) >= SKETCH_LEAST]
                met[near] = True
                met[k] |= len(near) > 0
                dense = dense or sum(map(len, left)) + len(near) > DENSE * len(block)
                if not dense:
                    left.append(np.minimum(names[near], names[k]))
                    right.append(np.maximum(names[near], names[k]))
            if dense:
                rows = np.flatnonzero(met)
                place = [pa.array([block[0][4 + k]] * len(rows), t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
                columns = [pa.array(names[rows]), pa.nulls(len(rows), pa.int64()), pa.array(roots[rows]), *place]
            elif left:
                left, right = np.concatenate(left), np.concatenate(right)
                columns = [pa.array(left), pa.array(right), pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.int64()),
                           pa.nulls(len(left), pa.int32()), pa.nulls(len(left), pa.int32())]
            else:
                continue
            yield pa.RecordBatch.from_arrays(columns, ["n", "w", "root", "key", "probe", "part"])

    again = dealt.select("key", "probe", "part", "n", "root", "asks", "sketch", *[F.col(c).alias(f"{c}_") for c in ("key", "probe", "part")])
    return again.mapInArrow(compare, "n bigint, w bigint, root bigint, key bigint, probe int, part int")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id) for every row with an id: the smallest id reachable over links."""
    docs = docs.where(F.col(id_col).isNotNull())
    signed = cut(signatures(docs, id_col, text))
    own = signed.groupBy("v").agg(F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    own = cut(own.withColumn("n", F.monotonically_increasing_id()))  # texts are numbered once
    vertices = own.select("n", "v", "least")
    tried = cut(_hub_pairs(own).select(F.least("n", "w").alias("n"), F.greatest("n", "w").alias("w")).distinct())
    links = _verified(tried, _sets(tried.select("n").union(tried.select("w")), docs, vertices, text, id_col))
    labelled = cut(_labelled(own.select("n", "sketch", "bands"), links))
    met = cut(_across(_placed(labelled, _layout(labelled))))
    pairs = cut(met.where("w is not null").select("n", "w").distinct().join(tried, ["n", "w"], "left_anti"))
    crowded = met.where("w is null").select("n", "root", "key", "probe", "part")
    if not met.isEmpty():
        sets = _sets(pairs.select("n").union(pairs.select("w")).union(crowded.select("n")), docs, vertices, text, id_col)
        links = links.unionByName(_verified(pairs, sets)).unionByName(_verified_blocks(crowded, sets))
        labelled = cut(_labelled(own.select("n"), links))
    final = vertices.join(labelled.select("n", "root"), "n")
    least = final.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.select("id", "v").join(final.select("v", "root"), "v").join(least, "root").select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", links: DataFrame | None = None) -> DataFrame:
    """One row of each group: the one with the smallest id. Rows without an id take no part and stay.

    Rows that repeat the surviving id are one document; the first in column order stays. ``links`` (src, dst) between
    ids, found by another method, join groups as well.
    """
    found = groups(docs, id_col, text)
    if links is not None:
        found = cut(found)
        joined = contract(links.unionByName(found.select(F.col("component_id").alias("src"), F.col("id").alias("dst"))))
        found = found.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component_id"))
    chosen = found.where("id = component_id").select(F.col("id").alias(id_col)).distinct()
    order = [F.col(f"`{c}`") for c in docs.columns if c != id_col and not dict(docs.dtypes)[c].startswith("map")]
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(*(order or [F.col(id_col)])))
    kept = docs.join(chosen, id_col, "left_semi").select("*", place.alias("__place")).where("__place = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
