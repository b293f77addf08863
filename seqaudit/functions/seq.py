"""DNA sequence expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .bit_distance import pair_distances
from .values import MISSING_WORDS, col, strip

# Preset recognition sites of the two common Golden Gate enzymes.
GOLDEN_GATE_SITES = ("GGTCTC", "CGTCTC")


def normalize_sequence(c) -> Column:
    text = strip(c)
    missing = col(c).isNull() | F.lower(text).isin("", *MISSING_WORDS)
    return F.when(missing, F.lit("")).otherwise(F.upper(F.regexp_replace(text, r"\s+", "")))


def normalize_dna(c) -> Column:
    return F.regexp_replace(F.upper(col(c)), "[^ACGTN]", "N")


def strip_to_acgt(c) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^ACGT]", "")


def valid_dna(c) -> Column:
    return F.coalesce(col(c).rlike("^[ACGTN]+$"), F.lit(False))


def invalid_symbols(c) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit("[^ACGTN]"), F.lit(0))))


def reverse_complement(c) -> Column:
    return F.reverse(F.translate(col(c), "ACGTN", "TGCAN"))


def sequence_hash(c) -> Column:
    return F.sha2(col(c), 256)


def canonical_hash(c) -> Column:
    return F.sha2(F.least(col(c), reverse_complement(c)), 256)


def count_bases(c, bases: str) -> Column:
    return F.length(col(c)) - F.length(F.translate(col(c), bases, ""))


def gc_fraction(c) -> Column:
    """G+C over the full length; N stays in the denominator."""
    return F.when(F.length(col(c)) > 0, count_bases(c, "GC") / F.length(col(c))).otherwise(F.lit(0.0))


def gc_fraction_acgt(c) -> Column:
    return gc_fraction(strip_to_acgt(c))


def gc_length_features(c) -> Column:
    return F.array(F.log1p(F.length(col(c)).cast("double")), gc_fraction(c))


def max_homopolymer(c) -> Column:
    runs = F.regexp_extract_all(col(c), F.lit("A+|C+|G+|T+|N+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def windows(c, k: int, symbols: str = "ACGT") -> Column:
    """All overlapping windows of k symbols, left to right; a window with any other symbol is skipped.

    A zero-width look-ahead lets one native regex pass return overlapping matches.
    """
    return F.regexp_extract_all(col(c), F.lit("(?=([%s]{%d}))" % (symbols, k)), F.lit(1))


def kmers(c, k: int = 8) -> Column:
    """Distinct k-mers in canonical orientation; windows with N are skipped.

    The complement of the i-th window is the i-th last window of the complemented
    sequence, so both strands are cut once and paired.
    """
    seq, n = col(c), F.length(col(c))
    forward = windows(seq, k)
    backward = F.reverse(windows(reverse_complement(seq), k))
    both = F.zip_with(forward, backward, lambda x, y: F.least(x, y))
    return (
        F.when(n >= k, F.array_distinct(both))
        .when(n > 0, F.array(seq))
        .otherwise(F.array().cast("array<string>"))
    )


def positional_kmers(c, k: int = 8) -> Column:
    """``position:kmer`` tokens, orientation kept; a short sequence is its own token."""
    seq, n = col(c), F.length(col(c))
    marked = F.transform(windows(seq, k, "ACGTN"), lambda w, i: F.concat_ws(":", i.cast("string"), w))
    clean = F.when(seq.contains("N"), F.filter(marked, lambda w: ~w.contains("N"))).otherwise(marked)
    return (
        F.when(n >= k, clean)
        .when(n > 0, F.array(F.concat(F.lit("0:"), seq)))
        .otherwise(F.array().cast("array<string>"))
    )


def vocabulary(k: int) -> list[str]:
    return ["".join(p) for p in product("ACGT", repeat=k)]


def kmer_code(c) -> Column:
    """Base-4 value of the k-mer plus one; 0 when a symbol is outside ACGT."""
    k = col(c)
    return F.when(
        k.rlike("^[ACGT]+$"), F.conv(F.translate(k, "ACGT", "0123"), 4, 10).cast("bigint") + 1
    ).otherwise(F.lit(0).cast("bigint"))


def kmer_codes(c, k: int) -> Column:
    """``kmer_code`` of every window of k symbols, left to right; null for null, empty below k symbols."""

    @F.arrow_udf("array<bigint>")
    def codes(seqs: pa.Array) -> pa.Array:
        texts = [t or "" for t in seqs.to_pylist()]
        # a line end behind each sequence makes every window across two of them unknown; those are left out
        base = _BASE_CODE[np.frombuffer("".join([t + "\n" for t in texts]).encode("ascii", "replace"), dtype=np.uint8)]
        n = max(0, len(base) - k + 1)
        total, known = np.zeros(n, np.int64), np.ones(n, bool)
        for at in range(k):
            total = total * 4 + base[at:at + n]
            known &= base[at:at + n] >= 0
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        held = np.maximum(lengths - k + 1, 0)
        ends = np.cumsum(held)
        inside = np.arange(held.sum()) + np.repeat(np.cumsum(lengths + 1) - lengths - 1 - ends + held, held)
        values = pa.array(np.where(known, total + 1, 0)[inside])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values, mask=pa.array(seqs.is_null()))

    return codes(col(c))


def kmer_frequencies(c, k: int) -> Column:
    """Dense frequency vector over ``vocabulary(k)``, normalised by the valid windows."""
    size = 4**k

    @F.pandas_udf("array<double>")
    def vectors(seqs: pd.Series) -> pd.Series:
        return pd.Series(list(kmer_matrix(seqs, k, size)))

    return vectors(col(c))


def kmer_matrix(seqs: pd.Series, k: int, size: int | None = None) -> np.ndarray:
    """Rows of k-mer frequencies for one Arrow batch of normalised sequences, counted some ``LETTERS`` at a time."""
    size = size or 4**k
    texts = seqs.tolist()
    out = np.zeros((len(texts), size))
    share = np.cumsum([len(t) for t in texts]) // LETTERS
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(share)) + 1):
        if len(rows):
            out[rows] = _window_shares(texts[rows[0]:rows[-1] + 1], k, size)
    return out


#: Letters of sequences whose windows are counted together.
LETTERS = 500_000


def _window_shares(texts: list[str], k: int, size: int) -> np.ndarray:
    # a line end between two sequences makes every window across them unknown
    base = _BASE_CODE[np.frombuffer("\n".join(texts).encode("ascii", "replace"), dtype=np.uint8)]
    n = max(0, len(base) - k + 1)
    codes, known = np.zeros(n, np.int64), np.ones(n, bool)
    for at in range(k):
        codes = codes * 4 + base[at:at + n]
        known &= base[at:at + n] >= 0
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[:n]
    counts = np.bincount(row[known] * size + codes[known], minlength=len(texts) * size).reshape(len(texts), size)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


_BASE_CODE = np.full(256, -1, dtype=np.int64)
for _i, _b in enumerate(b"ACGT"):
    _BASE_CODE[_b] = _i


def levenshtein(a, b) -> Column:
    """Edit distance in symbols, a batch of pairs at a time; null where either text is."""

    @F.pandas_udf("int")
    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        told = (left.notna() & right.notna()).to_numpy()
        out = pd.Series(pd.NA, index=left.index, dtype="Int32")
        out[told] = pair_distances(left[told].tolist(), right[told].tolist())
        return out

    return distances(col(a), col(b))


def hamming(a, b) -> Column:
    """Share of differing positions; 1.0 for empty or unequal lengths."""
    left, right = F.split(col(a), ""), F.split(col(b), "")
    differs = F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d))
    usable = (F.length(col(a)) > 0) & (F.length(col(a)) == F.length(col(b)))
    return F.when(usable, differs / F.length(col(a))).otherwise(F.lit(1.0))


def differences(parent, child) -> Column:
    """``position: A→C`` entries in order, then a note when the lengths differ.

    Both texts are split once and walked side by side; a split inside the lambda would be made for every position.
    """
    shared = F.coalesce(F.least(F.length(col(parent)), F.length(col(child))), F.lit(0))
    symbols = lambda c: F.slice(F.coalesce(F.split(col(c), ""), F.array().cast("array<string>")), F.lit(1), shared)
    changes = F.zip_with(symbols(parent), symbols(child), lambda x, y: F.when(x != y, F.concat(x, F.lit("→"), y)))
    text = F.array_compact(F.transform(changes, lambda c, i: F.concat((i + 1).cast("string"), F.lit(": "), c)))
    note = F.concat(F.lit("Length: "), F.length(col(parent)).cast("string"), F.lit("→"),
                    F.length(col(child)).cast("string"), F.lit(" nt"))
    unequal = F.length(col(parent)) != F.length(col(child))
    return F.concat(text, F.when(unequal, F.array(note)).otherwise(F.array().cast("array<string>")))


def complement_text(motif: str) -> str:
    return motif[::-1].translate(str.maketrans("ACGT", "TGCA"))


def motif_hits(c, motifs, both_strands: bool = True) -> Column:
    """Names of the motifs found, reverse-strand hits marked as such."""
    found = []
    for motif in motifs:
        rc = complement_text(motif)
        found.append(F.when(col(c).contains(motif), F.lit(motif)))
        if both_strands and rc != motif:
            found.append(F.when(col(c).contains(rc), F.lit(f"{motif} reverse complement")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def parse_motifs(c) -> Column:
    """Distinct upper-case motifs of a free-text list, in first-seen order."""
    parts = F.split(F.upper(F.coalesce(col(c), F.lit(""))), r"[\s,;]+")
    return F.array_distinct(F.filter(parts, lambda m: m != ""))


def invalid_motifs(c) -> Column:
    return F.filter(parse_motifs(c), lambda m: ~m.rlike("^[ACGT]+$"))


def masked_summary(c) -> Column:
    """Length, masked sites, GC of the fixed bases and invalid symbols of a masked parent."""
    compact = F.regexp_replace(F.replace(F.upper(F.coalesce(col(c), F.lit(""))), F.lit("[MASK]"), F.lit("N")),
                               r"\s+", "")
    fixed = strip_to_acgt(compact)
    return F.struct(
        F.length(compact).alias("length"),
        count_bases(compact, "N").alias("masked"),
        F.when(F.length(fixed) > 0, gc_fraction(fixed)).alias("fixed_gc"),
        F.array_join(invalid_symbols(compact), ",").alias("invalid"),
    )


def base_tokens(c, max_length: int) -> Column:
    """A0 C1 G2 T3; other symbols get id 0 and mask 0; padded or truncated to ``max_length``."""
    seq = normalize_dna(c)
    kept = F.least(F.length(seq), F.lit(max_length))
    symbols = F.slice(F.split(seq, ""), F.lit(1), kept)
    pad = F.array_repeat(F.lit(0), F.lit(max_length) - kept)
    ids = F.transform(symbols, _base_id)
    mask = F.transform(symbols, lambda s: F.when(s.isin("A", "C", "G", "T"), 1).otherwise(0))
    spans = F.concat(
        F.transform(symbols, lambda s, i: F.array(i, i + 1)),
        F.array_repeat(F.array(F.lit(0), F.lit(0)), F.lit(max_length) - kept),
    )
    return F.struct(
        F.concat(ids, pad).alias("input_ids"),
        F.concat(mask, pad).alias("attention_mask"),
        spans.alias("offsets"),
    )


def kmer_ids(c, offsets, k: int) -> Column:
    """Code of the first k bases of each span; 0 for spans shorter than k."""
    seq = F.upper(col(c))
    return F.transform(
        col(offsets),
        lambda o: F.when(o[1] - o[0] < k, F.lit(0).cast("bigint")).otherwise(
            kmer_code(F.substring(seq, o[0] + 1, F.lit(k)))),
    )


def _base_id(s: Column) -> Column:
    return F.when(s == "C", 1).when(s == "G", 2).when(s == "T", 3).otherwise(0)


def decode_bases(ids) -> Column:
    names = F.array(*[F.lit(b) for b in "ACGT"])
    return F.array_join(F.transform(col(ids), lambda i: F.element_at(names, i + 1)), "")
