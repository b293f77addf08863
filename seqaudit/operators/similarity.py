"""Similarity policies as exact blocked joins that feed components, not all pairs.

What the audit needs from a similarity policy is which rows end up in one leakage
component. So no operator here emits all pairs of a group of near-copies: equal rows
collapse onto one representative, hot buckets are first merged through hubs, and only
pairs whose rows are still in different components are compared afterwards.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import seq
from ..functions.token_sets import WIDEST, CodedSets
from ..functions.values import col, is_missing
from ..session import cut, forget, parallelism, release, settle
from .components import connected_components, contract, group_edges

HUB_SHARE = 512
PAIRS_PER_POSTING = 300
BROADCAST_ROWS = 500_000
EPS = 1e-9

# Accepted policy names and the policy each stands for.
POLICY_ALIASES = {
    "canonical_kmer_jaccard": "canonical_kmer_jaccard",
    "kmer_jaccard": "canonical_kmer_jaccard",
    "minhash_kmer": "canonical_kmer_jaccard",
    "exact_reverse_complement": "exact_reverse_complement",
    "edit_distance": "edit_distance",
    "position_aware_motif": "position_aware_motif",
    "customer_family_labels": "customer_family_labels",
}
# Names kept for the diversity methods.
RESERVED_NAMES = ("greedy_embedding_cosine", "greedy_edit_distance", "kmer_cosine")

_NAME = re.compile(r"[a-z][a-z0-9_]{0,63}")

Similarity = Callable[[pd.Series, pd.Series], pd.Series]


# --- names and plugins ------------------------------------------------------------

class PolicyBook(dict):
    """Registered similarities by tidy name, next to the built-in ones."""

    @staticmethod
    def tidy(name: str | None) -> str:
        """Lower case with underscores; anything else is no name."""
        found = _NAME.fullmatch("_".join(re.split(r"[-\s]+", str(name or "").strip().lower())))
        if not found:
            raise ValueError(f"{name!r} is no similarity policy name")
        return found.group()

    def add(self, name: str, fn: Similarity, replace: bool) -> str:
        tidy = self.tidy(name)
        problem = (
            (ValueError, "belongs to a built-in method") if {tidy} & (POLICY_ALIASES.keys() | set(RESERVED_NAMES)) else
            (TypeError, "needs a function of two series") if not callable(fn) else
            (ValueError, "exists; pass replace=True") if tidy in self and not replace else None)
        if problem:
            raise problem[0](f"similarity policy {tidy!r} {problem[1]}")
        self[tidy] = fn
        return tidy

    def meaning(self, name: str) -> str:
        tidy = self.tidy(name)
        known = POLICY_ALIASES | {own: own for own in self}
        if tidy not in known:
            raise ValueError(f"no similarity policy is called {tidy!r}")
        return known[tidy]


_PLUGINS = PolicyBook()


def policy_name(name: str) -> str:
    return PolicyBook.tidy(name)


@dataclass(frozen=True)
class Declared:
    """What a registered policy says about the pairs it can join."""

    keys: Callable[[Column, float], Column] | None = None  # (sequence, threshold) -> array of keys
    metric: bool = False  # 1 - similarity obeys the triangle inequality


_DECLARED: dict[str, Declared] = {}


def register_similarity_policy(name: str, fn: Similarity, replace: bool = False, keys: Callable[[Column, float], Column] | None = None,
                               metric: bool = False) -> str:
    """Register a vectorised similarity over two aligned series of normalised sequences.

    ``keys`` gives the keys of a sequence at a threshold: sequences that similar must share one. ``metric``
    says that 1 - similarity is a distance. Either lets a table of any size be searched; without
    them the function is opaque and all pairs are scored.
    """
    tidy = _PLUGINS.add(name, fn, replace)
    _DECLARED[tidy] = Declared(keys, metric)
    return tidy


def unregister_similarity_policy(name: str) -> bool:
    """Forget a registered similarity; False if there was none. Built-in ones stay."""
    if (tidy := policy_name(name)) in POLICY_ALIASES:
        raise ValueError(f"{tidy!r} is built in")
    _DECLARED.pop(tidy, None)
    return bool(_PLUGINS.pop(tidy, None))


def registered_similarity_policies() -> tuple[str, ...]:
    return tuple(sorted(_PLUGINS))


def registered_similarity(name: str) -> Similarity:
    return _PLUGINS[policy_name(name)]


def resolve_policy(name: str | None = None, other: str | None = None) -> str:
    """Policy behind one name, or behind two names that must agree."""
    meant = sorted({_PLUGINS.meaning(n) for n in (name, other) if n is not None})
    if len(meant) == 2:
        raise ValueError(f"two similarity policies at once: {' and '.join(meant)}")
    return meant[0] if meant else "canonical_kmer_jaccard"


# --- scores of one pair -----------------------------------------------------------

def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))


def jaccard_once(a: Column, b: Column) -> Column:
    """``jaccard`` of two derived token arrays: as lambda variables they are derived a single time, not at every mention."""
    counted = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda t: F.struct(
        F.size(F.array_intersect(t["a"], t["b"])).alias("both"), (F.size(t["a"]) + F.size(t["b"])).alias("all")))
    share = lambda t: F.when(t["all"] == t["both"], F.lit(1.0)).otherwise(
        t["both"] / F.greatest(t["all"] - t["both"], F.lit(1)))
    return F.transform(counted, share)[0]


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1 - F.levenshtein(a, b) / longest


def checked_plugin(name: str) -> Callable[[Column, Column], Column]:
    """Plugin score; a value outside [0, 1] fails the job."""
    fn = _PLUGINS[name]

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fn(a, b)).astype(float)

    def checked(a: Column, b: Column) -> Column:
        value = score(a, b)
        good = value.between(0, 1) & ~F.isnan(value)
        return F.when(good, value).otherwise(
            F.raise_error(F.lit(f"similarity policy {name} must return values in [0, 1]")).cast("double"))

    return checked


def pair_similarity(a, b, policy: str | None = None, k: int = 8, left_groups: list[Column] = [],
                    right_groups: list[Column] = []) -> Column:
    """Similarity column of two normalised sequences under a named policy."""
    a, b, policy = col(a), col(b), resolve_policy(policy)
    if k <= 0:
        raise ValueError("k must be positive")
    if policy == "canonical_kmer_jaccard":
        return jaccard_once(seq.kmers(a, k), seq.kmers(b, k))
    if policy == "position_aware_motif":
        return jaccard_once(seq.positional_kmers(a, k), seq.positional_kmers(b, k))
    if policy == "exact_reverse_complement":
        same = F.least(a, seq.reverse_complement(a)) == F.least(b, seq.reverse_complement(b))
        return same.cast("double")
    if policy == "edit_distance":
        return 1 - seq.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    if policy == "customer_family_labels":
        if not left_groups or len(left_groups) != len(right_groups):
            raise ValueError("customer_family_labels needs the same group columns on both sides")
        shared = F.lit(False)
        for x, y in zip(left_groups, right_groups):
            shared = shared | F.coalesce(~is_missing(x) & ~is_missing(y) & (F.trim(x) == F.trim(y)), F.lit(False))
        return shared.cast("double")
    return checked_plugin(policy)(a, b)


# --- blocked merging --------------------------------------------------------------

@dataclass
class Block:
    """A table of (id, key, …) postings plus the tests applied to a pair sharing a key."""

    postings: DataFrame
    carried: list[str]
    keep: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
    sets: DataFrame
    score: Callable[[Column, Column], Column]
    threshold: float
    sizes: DataFrame | None = None
    derive: Callable[[Column], Column] = lambda c: c
    merge: DataFrame | None = None
    parts: Callable[[DataFrame, bool], DataFrame] | None = None  # postings of labelled rows: those they hold, or those they ask for
    tally: list[tuple[int, int]] | None = None  # per comparison step: pairs compared, pairs found similar


def bucket_sizes(postings: DataFrame) -> DataFrame:
    """Keys that at least two rows share."""
    return cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))


def verified(block: Block, pairs: DataFrame) -> DataFrame:
    """Pairs whose exact similarity reaches the threshold.

    Tokens are derived once per row that occurs in a pair, not once per pair.
    """
    pairs = cut(pairs)
    used = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    compared = pairs.count()
    if compared <= BROADCAST_ROWS // 2:
        used = F.broadcast(used)
    rows = block.sets.join(used, "id", "left_semi").select("id", block.derive(F.col("payload")).alias("payload"))
    rows = settle(rows)
    a = rows.select(F.col("id").alias("src"), F.col("payload").alias("pa"))
    b = rows.select(F.col("id").alias("dst"), F.col("payload").alias("pb"))
    scored = pairs.join(a, "src").join(b, "dst").withColumn("similarity", block.score(F.col("pa"), F.col("pb")))
    found = scored.where(F.col("similarity") >= block.threshold - EPS).select("src", "dst", "similarity")
    if block.tally is not None:
        found = cut(found)
        block.tally.append((compared, found.count()))
    return found


def candidate_pairs(block: Block, left: DataFrame, right: DataFrame, extra: Column | None = None) -> DataFrame:
    l, r = left.alias("l"), right.alias("r")
    take = lambda side: (lambda name: F.col(f"{side}.{name}"))
    cond = (F.col("l.key") == F.col("r.key")) & block.keep(take("l"), take("r"))
    if extra is not None:
        cond = cond & extra
    return l.join(r, cond).select(
        F.least("l.id", "r.id").alias("src"), F.greatest("l.id", "r.id").alias("dst")).distinct()


def merging_edges(block: Block, hot: int | None = None) -> DataFrame:
    """Edges that give the same components as all similar pairs would.

    First near-copies are merged with one comparison per row and merge key. Then the
    rows that share a key but not yet a component are compared.
    """
    hot = hot or HUB_SHARE
    found = near_copy_links(block, hot)
    pairs = apart_pairs(block, None if found is None else cut(contract(found)), hot).select("src", "dst")
    return pairs if found is None else pairs.union(found)


def apart_pairs(block: Block, labels: DataFrame | None, hot: int | None = None) -> DataFrame:
    """Verified pairs (src, dst, similarity) of rows that share a key but no component of ``labels`` (id, component)."""
    hot = hot or HUB_SHARE
    if block.parts is not None:
        rows = block.sets.select("id", "payload", *block.carried)
        rows = rows.withColumn("component", F.col("id")) if labels is None else settle(
            rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
        return verified(block, piece_pairs(*shared_parts(block, rows), hot, block.keep))
    sizes = bucket_sizes(block.postings) if block.sizes is None else block.sizes
    shared = block.postings.join(sizes, "key")
    before = F.col("l.id") < F.col("r.id")
    if labels is None:
        return verified(block, candidate_pairs(block, shared, shared, before))
    held = labels.groupBy("component").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("top"), F.sum("c").alias("rows")).first()
    largest = held["top"] or 0
    # few linked rows: send them to the postings instead of shuffling the postings by id
    near = F.broadcast(labels) if (held["rows"] or 0) <= BROADCAST_ROWS else labels
    shared = shared.join(near, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = F.col("l.component") != F.col("r.component")
    if largest <= hot:
        pairs = candidate_pairs(block, shared, shared, apart & before)
    else:
        rest, everything = without_largest(shared)
        pairs = candidate_pairs(block, rest, everything, apart & (before | (F.col("r.component") == F.col("r.big"))))
    return verified(block, pairs)


def shared_parts(block: Block, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings that ``rows`` ask for, postings they hold) under the keys that rows of two components hold.

    A row asks for keys it holds itself, and most keys are held by one row or by one component. So only the keys and
    components of all postings are shuffled, summed up where they are read; whatever else a pair is tested by is fetched for the few that are left.
    """
    ends = [F.min("component").alias("low"), F.max("component").alias("high")]
    release(rows.sparkSession)
    live = settle(block.parts(rows, False).groupBy("key").agg(*ends).where("low <> high").select("key"))
    release(rows.sparkSession)
    near = F.broadcast(live) if live.count() <= BROADCAST_ROWS else live
    carried = rows.select("id", "component", *block.carried)

    def kept(asked: bool) -> DataFrame:
        return settle(settle(block.parts(rows, asked).select("id", "key").join(near, "key", "left_semi")).join(carried, "id"))

    return kept(True), kept(False)


def near_copy_links(block: Block, hot: int) -> DataFrame | None:
    """Links between rows and the hub of their merge key; two turns with different hubs."""
    sizes = block.merge.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    if block.carried and set(block.carried) <= set(block.sets.columns):
        # what belongs to the row, not to its key, is fetched for the rows that share a key
        met = settle(block.merge.select("id", "key").join(sizes, "key"))
        members = settle(met.join(block.sets.select("id", *block.carried), "id"))
        forget(met)
    else:
        members = cut(block.merge.join(sizes, "key"))
    release(members.sparkSession)
    if members.isEmpty():
        return None
    found, labelled = None, members.withColumn("component", F.col("id"))
    for turn in range(2):
        links = cut(verified(block, hub_pairs(block, labelled, hot, turn)).select("src", "dst"))
        if links.isEmpty():
            break
        found = links if found is None else found.union(links)
        if turn == 0:
            labels = contract(found)
            labelled = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return found


def hub_pairs(block: Block, labelled: DataFrame, hot: int, turn: int) -> DataFrame:
    """One comparison per member: against the hub of its salted share; then each hub against the key's hub."""
    salted = labelled.withColumn("share", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("held") / F.lit(hot))))
    low = F.min(F.struct(F.xxhash64("component", F.lit(turn)).alias("o"), "id", "component", *block.carried))
    hubs = salted.groupBy("key", "share").agg(low.alias("h"))
    top = hubs.groupBy("key").agg(F.min("h").alias("h"))
    fields = lambda df, extra: df.select("key", *extra, "h.id", "h.component", *[f"h.{c}" for c in block.carried])
    within = candidate_hub(block, salted, fields(hubs, ["share"]), ["key", "share"])
    across = candidate_hub(block, fields(hubs, ["share"]), fields(top, []), ["key"])
    return within.union(across).distinct()


def candidate_hub(block: Block, members: DataFrame, hubs: DataFrame, keys: list[str]) -> DataFrame:
    l, r = members.alias("l"), hubs.alias("r")
    take = lambda side: (lambda name: F.col(f"{side}.{name}"))
    cond = block.keep(take("l"), take("r")) & (F.col("l.component") != F.col("r.component"))
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, cond).select(F.least("l.id", "r.id").alias("src"), F.greatest("l.id", "r.id").alias("dst"))


def without_largest(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings outside their bucket's largest component, and all postings of those buckets.

    A pair inside the largest component needs no comparison, so only the others probe.
    """
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    biggest = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("c", "component")).alias("big"), F.count(F.lit(1)).alias("parts"))
    mixed = cut(labelled.join(biggest.where("parts > 1"), "key"))
    return mixed.where("component <> big"), mixed


# --- set similarity ---------------------------------------------------------------

#: Least threshold at which coded sets meet under equal parts instead of their rarest tokens.
IN_PARTS = 0.8


def token_sets(policy: str, k: int) -> Callable[[Column], Column]:
    """The token sets of a set policy: as codes, or as texts where a k-mer is too long for one."""
    places = policy == "position_aware_motif"
    if k <= WIDEST:
        return CodedSets(k, places)
    return (lambda c: seq.positional_kmers(c, k)) if places else (lambda c: seq.kmers(c, k))


def summarise(df: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """Per row: set size, sorted token hashes, 256-bit bitmap."""
    if isinstance(tokens, CodedSets):
        return df.select("id", "payload", tokens.summary("payload").alias("s")).select("id", "payload", F.size("s.hashed").alias("n"), "s.*")
    toks = df.withColumn("tokens", tokens(F.col("payload"))).withColumn("n", F.size("tokens"))
    toks = toks.withColumn("hashed", F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t))))
    for word in range(4):
        toks = toks.withColumn(f"w{word}", bitmap_word("hashed", word))
    return toks.select("id", "payload", "n", "hashed", "w0", "w1", "w2", "w3")


#: Entries of the frequency table that every task gets (16 bytes each).
FREQUENT = 200_000
#: Rows holding the most frequent token up to which frequencies are not worth an order.
LIGHT = 64


def rarest_first(reps: DataFrame, keep: Column, frequent: int = FREQUENT, light: int = 0) -> DataFrame:
    """Add ``prefix``: the ``keep`` rarest of the token hashes, in one order for all rows.

    Tokens are ordered by (frequency, hash). Only the ``frequent`` most frequent shared
    tokens have a place in the table; all others count as unique, which changes the order
    but not its being common to all rows, so a prefix filter stays exact.
    """
    counts = cut(reps.select(F.explode("hashed").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    if (counts.agg(F.max("held")).first()[0] or 0) <= light:
        # no list is long whatever the order: the hashes, which are sorted, do as well
        return reps.withColumn("prefix", F.slice("hashed", F.lit(1), F.greatest(keep, F.lit(0))))
    top = counts.orderBy(F.desc("held"), "key").limit(frequent).toPandas().sort_values("key")
    table = reps.sparkSession.sparkContext.broadcast((top["key"].to_numpy("int64"), top["held"].to_numpy("int64")))

    @F.pandas_udf("array<bigint>")
    def order(hashed: pd.Series, wanted: pd.Series) -> pd.Series:
        keys, held = table.value
        sizes = np.fromiter(map(len, hashed), "int64", len(hashed))
        flat = np.concatenate([np.asarray(h, "int64") for h in hashed]) if len(hashed) else np.zeros(0, "int64")
        at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
        often = np.where(keys[at] == flat, held[at], 1) if len(keys) else np.ones(len(flat), "int64")
        row = np.repeat(np.arange(len(sizes)), sizes)
        sorted_ = flat[np.lexsort((flat, often, row))]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return pd.Series([sorted_[a:a + max(0, k)] for a, k in zip(starts, wanted)])

    return reps.withColumn("prefix", order("hashed", keep))


def bitmap_word(hashed: str, word: int) -> Column:
    """64 of the 256 bits that the token hashes set."""
    inside = F.filter(hashed, lambda h: F.pmod(F.shiftright(h, 6), F.lit(4)) == word)
    one = F.lit(1).cast("bigint")
    return F.aggregate(inside, F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseOR(
        F.call_function("shiftleft", one, F.pmod(h, F.lit(64)).cast("int"))))


def collapse(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Representatives (smallest id per key) and star edges from each to its equals."""
    first = df.groupBy(key).agg(F.min("id").alias("src"), F.count(F.lit(1)).alias("copies"))
    stars = df.select(key, F.col("id").alias("dst")).join(first.where("copies > 1").drop("copies"), key).where(
        "src <> dst").select("src", "dst")
    reps = df.join(first.select(F.col("src").alias("id")), "id", "left_semi")
    return reps, stars


def overlap_needed(threshold: float, na: Column, nb: Column) -> Column:
    return F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - EPS)


class SetTable:
    """Token sets of (id, payload) rows, summarised once for all thresholds from ``low`` up.

    ``stars`` ties rows with equal sets to their representative; ``block`` gives the keys of the
    representatives at a threshold.
    """

    def __init__(self, df: DataFrame, tokens: Callable[[Column], Column], low: float):
        self.tokens, self.low = tokens, low
        # a set takes ten times the room of its sequence: it is derived again where it is read, and only its digest is kept
        digest = tokens.digest("payload") if isinstance(tokens, CodedSets) else F.unhex(
            F.sha2(F.array_join(F.array_sort(tokens(F.col("payload"))), " "), 256))
        self.in_parts = isinstance(tokens, CodedSets) and low >= IN_PARTS
        table = settle(df.select("id", "payload", digest.alias("digest")))
        firsts, stars = collapse(table, "digest")
        reps, self.stars = settle(firsts.select("id", "payload")), settle(stars)
        forget(table)
        release(reps.sparkSession)
        kept = self._kept(low)
        summed = summarise(reps.repartition(parallelism(reps.sparkSession), "id"), tokens)
        # near-copies meet under their lowest hashes, which a change rarely touches; pairs are sought under the rarest tokens
        ranked = summed if self.in_parts else rarest_first(summed, kept, light=LIGHT)
        self.reps = settle(ranked.withColumn("merged", merge_keys(F.slice("hashed", 1, F.greatest(kept, F.lit(0))))).drop("hashed"))
        forget(reps)
        release(reps.sparkSession)

    @staticmethod
    def _kept(threshold: float) -> Column:
        return F.least(F.col("n"), F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - EPS).cast("int") + 2)

    def block(self, threshold: float, tally: list[tuple[int, int]] | None = None) -> Block:
        if threshold < self.low:
            raise ValueError(f"the sets were prepared for thresholds from {self.low} up")
        words = ["w0", "w1", "w2", "w3"]
        need = F.ceil(F.lit(threshold) * F.col("n") - EPS).cast("int")
        first = lambda name: F.slice(name, F.lit(1), F.greatest(self._kept(threshold), F.lit(0)))

        def keep(a, b):
            differing = sum((F.bit_count(a(w).bitwiseXOR(b(w))) for w in words), F.lit(0))
            long_enough = (a("n") >= threshold * b("n") - EPS) & (b("n") >= threshold * a("n") - EPS)
            return long_enough & ((a("n") + b("n") - differing) / 2 >= overlap_needed(threshold, a("n"), b("n")))

        # a key of the lowest hashes ends at its third, sixth, ... hash
        merge = self.reps.select("id", "n", *words, F.explode(F.slice("merged", F.lit(1), F.floor(self._kept(threshold) / 3).cast("int"))).alias("key"))
        if self.in_parts:

            def parts(rows: DataFrame, asked: bool) -> DataFrame:
                return rows.select("id", "n", *words, "component", F.explode(self.tokens.part_keys("payload", threshold, asked)).alias("key"))

            return Block(merge, ["n", *words], keep, self.reps, jaccard, threshold, None, self.tokens, merge, parts, tally)
        reps = self.reps.withColumn("prefix", first("prefix"))
        postings = reps.select("id", "n", *words,
                               F.explode(F.slice("prefix", F.lit(1), F.greatest(F.col("n") - need + 1, F.lit(0)))).alias("key"))
        sizes = bucket_sizes(postings)
        cost = sizes.agg(F.sum(F.col("held") * (F.col("held") - 1) / 2).alias("pairs"), F.sum("held").alias("rows")).first()
        if threshold >= 0.8 and (cost["pairs"] or 0) > PAIRS_PER_POSTING * max(1, cost["rows"] or 0):
            # two shared prefix tokens are required instead of one: longer keys, smaller buckets
            postings = reps.select("id", "n", *words, F.explode(token_pairs("prefix")).alias("key"))
            sizes = None
        return Block(postings, ["n", *words], keep, reps, jaccard, threshold, sizes, self.tokens, merge, tally=tally)


def set_similarity_edges(df: DataFrame, tokens: Callable[[Column], Column], threshold: float,
                         hot: int | None = None, tally: list[tuple[int, int]] | None = None) -> DataFrame:
    """Edges spanning the components of ``jaccard >= threshold`` over (id, payload) rows."""
    table = SetTable(df, tokens, threshold)
    return merging_edges(table.block(threshold, tally), hot).select("src", "dst").union(table.stars)


def pair_diagnostics(df: DataFrame, tokens: Callable[[Column], Column], threshold: float) -> DataFrame:
    """One row: rows, possible pairs, pairs compared, pairs verified, pairs skipped, components.

    Takes (id, payload). Equal sets are one row of the search; a pair is compared only if
    its rows share a key, pass the size and bitmap bounds and are still in different components.
    """
    tally: list[tuple[int, int]] = []
    edges = cut(set_similarity_edges(df, tokens, threshold, tally=tally))
    comps = connected_components(df.select("id"), edges)
    n = df.count()
    possible, compared, verified = n * (n - 1) // 2, sum(a for a, _ in tally), sum(b for _, b in tally)
    count = lambda value, name: F.lit(value).cast("bigint").alias(name)
    return comps.agg(F.countDistinct("component").alias("components")).select(
        count(n, "rows"), count(possible, "possible_pairs"), count(compared, "candidate_pairs"), count(verified, "verified_pairs"),
        count(possible - compared, "skipped_pairs"), "components")


def merge_keys(name) -> Column:
    """Up to five keys of three neighbouring lowest token hashes: near-copies share some, other rows hardly any."""
    name = col(name)
    starts = F.filter(F.array(*[F.lit(i) for i in (1, 4, 7, 10, 13)]), lambda i: i + 2 <= F.size(name))
    at = lambda i: F.element_at(name, i)
    return F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))


def token_pairs(name: str) -> Column:
    """Keys of all two-token combinations of a short sorted array."""
    last = F.size(name)
    return F.flatten(F.transform(F.col(name), lambda x, i: F.transform(
        F.slice(F.col(name), i + 2, F.greatest(last - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))


# --- edit distance ----------------------------------------------------------------

#: Postings of pieces that are joined in one turn.
TURN_POSTINGS = 50_000_000


def edit_distance_edges(df: DataFrame, threshold: float, hot: int | None = None) -> DataFrame:
    """Edges spanning the components of ``1 - lev/max(len) >= threshold``.

    A string of length L within distance d of a shorter one shares, unchanged and
    nearly in place, one of any d+1 pieces it is cut into. Pieces of the longer string
    and the matching substrings of the shorter one become the keys. With b the edits of each piece,
    the last prefix whose edits are no fewer than its pieces ends before an unchanged piece, and
    the piece behind that one has at most one edit: pairs are compared only if it has.
    """
    hot = hot or HUB_SHARE
    base = df.withColumn("n", F.length("payload"))
    reps, stars = collapse(base, "payload")
    reps = settle(reps.withColumn("code", base_digits("payload")))  # kept: it would be derived anew at every posting
    # spans depend on lengths alone: one row per (length, partner length, piece), joined like any table
    spans = settle(partner_lengths(reps.select("n").distinct(), threshold).select(
        "n", "other", F.explode(piece_spans(F.col("n"), F.col("other"), threshold)).alias("p")).select("n", "other", "p.*"))
    few = spans.count() <= BROADCAST_ROWS

    def postings(rows: DataFrame, own: bool, some: Column = F.lit(True)) -> DataFrame:
        side = spans.where((F.col("own") == own) & some)
        dealt = rows.repartition(parallelism(rows.sparkSession), "id")  # a few MB of rows make many postings
        keyed = dealt.join(F.broadcast(side) if few else side, "n")
        starts = keyed.withColumn("at", F.explode(F.sequence("lo", "hi")))
        key = F.xxhash64("other", "seg", F.substr("payload", "at", "width"))
        behind = digits_at("code", F.col("at") + F.col("width"), F.col("next") + (0 if own else 1))
        # a piece without a next one has no letters to compare on either side
        return starts.select(*rows.drop("payload", "code").columns, key.alias("key"), F.when(F.col("next") > 0, behind).otherwise(F.lit(0)).alias("behind"),
                             F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * F.col("next")).alias("past"))

    def keep(a, b):
        # for merging near-copies: pieces of equal place and length, the next ones with one other letter at most
        return one_letter(mismatches(a("behind"), b("behind")))

    limit = lambda a, b: F.floor((1 - threshold) * F.greatest(F.length(a), F.length(b)) + EPS).cast("int")

    def score(a, b):
        # banded: a distance above the limit is reported as -1 and stops early
        dist = F.call_function("levenshtein", a, b, limit(a, b))
        return F.when(dist >= 0, 1 - dist / F.greatest(F.length(a), F.length(b), F.lit(1))).otherwise(F.lit(-1.0))

    merge = postings(reps, True).select("id", "behind", "key")
    block = Block(merge, ["behind"], keep, reps, score, threshold, merge=merge)
    found = near_copy_links(block, hot)
    rows = reps.withColumn("component", F.col("id"))
    if found is not None:
        found = cut(found)
        labels = contract(found)
        rows = settle(reps.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    # a row makes some hundred postings: pieces are taken in turns, so that the disk holds a bounded number of them, whatever the rows
    made = spans.join(reps.groupBy("n").agg(F.count(F.lit(1)).alias("rows")), "n").agg(
        F.sum((F.col("hi") - F.col("lo") + 1) * F.col("rows")).alias("postings"), F.max("seg").alias("last")).first()
    turns = min(-(-(made["postings"] or 0) // TURN_POSTINGS) or 1, (made["last"] or 0) + 1)
    edges = stars
    for turn in range(turns):
        mine = F.pmod(F.col("seg"), F.lit(turns)) == turn
        pairs = piece_pairs(postings(rows, True, mine), postings(rows, False, mine).drop("past"), hot)
        alike = verified(block, pairs).select("src", "dst")
        if turns > 1:
            alike = settle(alike)
            release(rows.sparkSession)
        edges = alike.union(edges)
    return edges if found is None else edges.union(found)


def piece_pairs(own: DataFrame, probes: DataFrame, hot: int, keep: Callable | None = None) -> DataFrame:
    """Pairs (src, dst) of a piece and an equal substring from different components whose next pieces differ by one edit at most.

    With ``keep``, pairs of a larger set's key and an equal one of another set that pass that test. A component that holds more than ``hot`` pieces of a key is not compared with itself: its pieces meet only the other substrings.
    """
    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        l, r = left.alias("l"), right.alias("r")
        # of two strings of equal length the pieces of one are enough
        order = (F.col("l.n") > F.col("r.n")) | (F.col("l.id") < F.col("r.id"))
        take = lambda side: (lambda name: F.col(f"{side}.{name}"))
        near = keep(take("l"), take("r")) if keep else within_one_edit(F.col("l.behind"), F.col("l.past"), F.col("r.behind"))
        cond = (F.col("l.key") == F.col("r.key")) & order & (F.col("l.component") != F.col("r.component")) & near
        return l.join(r, cond).select(F.least("l.id", "r.id").alias("src"), F.greatest("l.id", "r.id").alias("dst"))

    counts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot)
    large = cut(counts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("big")))
    if large.isEmpty():
        return join(own, probes).distinct()
    held, asked = own.join(large, "key", "left"), probes.join(large, "key")
    same = F.col("component") == F.col("big")
    rest = join(held.where(F.col("big").isNull() | ~same), probes)
    return rest.union(join(held.where(same), asked.where(~same))).distinct()


#: Letters of the next piece that are compared; two bits each and one letter more must fit a long.
BEHIND = 30
_LOW_BITS = 0x5555555555555555


def base_digits(name: str) -> Column:
    """The text with every letter as a digit of base 4; letters other than CGT are like A, which keeps equal letters equal."""
    return F.translate(F.regexp_replace(name, "[^CGT]", "A"), "ACGT", "0123")


def digits_at(code: str, at: Column, length: Column) -> Column:
    """``length`` digits from ``at`` as one number, the first letter highest; zeros behind the end."""
    return F.conv(F.rpad(F.substr(code, at, length), length, F.lit("0")), 4, 10).cast("bigint")


def within_one_edit(piece: Column, past: Column, letters: Column) -> Column:
    """Whether a piece of w letters is one edit or less from a prefix of the w+1 ``letters``; ``past`` is 4 to the w.

    Texts that differ by one letter more or less agree before some place when aligned at their fronts
    and behind it when aligned at their ends: no mismatch of the first kind may lie above one of the second.
    """
    quarter = lambda c: F.shiftright(c, 2)
    apart = lambda front, back: (back == 0) | (front < back.bitwiseAND(-back))
    front = mismatches(piece, quarter(letters))
    more = apart(front, mismatches(piece, letters.bitwiseAND(past - 1)))
    shorter = quarter(quarter(letters))
    less = apart(mismatches(quarter(piece), shorter), mismatches(piece.bitwiseAND(quarter(past) - 1), shorter))
    return one_letter(front) | more | ((past > 1) & less)


def mismatches(a: Column, b: Column) -> Column:
    """One bit for every digit of base 4 that differs."""
    both = a.bitwiseXOR(b)
    return both.bitwiseOR(F.shiftright(both, 1)).bitwiseAND(F.lit(_LOW_BITS))


def one_letter(found: Column) -> Column:
    return found == found.bitwiseAND(-found)


def _allowed(length: Column, threshold: float) -> Column:
    return F.floor((1 - threshold) * length + EPS).cast("int")


def partner_lengths(lengths: DataFrame, threshold: float) -> DataFrame:
    """(n, other): for each length the occurring lengths, itself included, of longer strings it may be similar to."""
    top = lengths.agg(F.max("n")).first()[0] or 0
    most = F.least(F.floor(F.col("n") / F.lit(threshold)) + 1, F.lit(top)).cast("int")
    wide = lengths.select("n", F.explode(F.sequence(F.col("n"), F.greatest(most, F.col("n")))).alias("other"))
    near = wide.where(F.col("other") - _allowed(F.col("other"), threshold) <= F.col("n"))
    return near.join(lengths.select(F.col("n").alias("other")), "other", "left_semi")


def piece_spans(n: Column, other: Column, threshold: float) -> Column:
    """Where each piece of a string of length ``other`` may start in one of length ``n``.

    An array of (seg, width, next, own, lo, hi); ``own`` spans are the pieces' own places, found
    only in strings of full length, ``next`` the letters of the next piece to compare, 0 behind the last. With more
    pieces than letters everything shares one key.
    """
    d = _allowed(other, threshold)
    pieces, gap = d + 1, other - n

    def spans(i: Column) -> Column:
        edge = F.floor(other * i / pieces).cast("int")
        width = F.floor(other * (i + 1) / pieces).cast("int") - edge
        behind = F.when(i < d, F.least(F.floor(other * (i + 2) / pieces).cast("int") - edge - width, F.lit(BEHIND))).otherwise(F.lit(0))
        at, right = edge + 1, d - i
        lo = F.greatest(at - i, at - gap - right, F.lit(1))
        hi = F.least(at + i, at - gap + right, n - width + 1)
        span = lambda own, low, high: F.struct(i.alias("seg"), width.alias("width"), behind.alias("next"), F.lit(own).alias("own"), low.alias("lo"), high.alias("hi"))
        return F.when(n == other, F.array(span(True, at, at), span(False, lo, hi))).otherwise(F.array(span(False, lo, hi)))

    zero = F.lit(0)
    whole = lambda own: F.struct(zero.alias("seg"), zero.alias("width"), zero.alias("next"), F.lit(own).alias("own"), F.lit(1).alias("lo"), F.lit(1).alias("hi"))
    everything = F.when(n == other, F.array(whole(True), whole(False))).otherwise(F.array(whole(False)))
    cuts = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), d), spans)), lambda s: s["lo"] <= s["hi"])
    return F.when(pieces > other, everything).otherwise(cuts)


# --- other policies ---------------------------------------------------------------

def reverse_complement_edges(df: DataFrame) -> DataFrame:
    """Rows whose sequences are equal up to strand share a key; no pairs are compared."""
    keyed = df.select("id", F.least("payload", seq.reverse_complement("payload")).alias("key"))
    return collapse(keyed, "key")[1]


#: Pivots whose distances bound those of a declared metric; the first two also give the keys.
METRIC_PIVOTS = 8


def declared_edges(df: DataFrame, policy: str, threshold: float, hot: int | None = None,
                   tally: list[tuple[int, int]] | None = None) -> DataFrame:
    """Edges of a registered policy that declares its keys or that it is a metric.

    Of a metric, rows within r = 1 - threshold differ by at most r in their distance to any pivot: cells of that width, each
    row in its own and the next, are the keys, and the distances to all pivots prune the pairs.
    """
    reps, stars = collapse(df, "payload")
    told, carried = _DECLARED[policy], []
    if told.keys is not None:
        reps = cut(reps)
        found = F.transform(F.array_distinct(told.keys(F.col("payload"), threshold)), lambda k: F.xxhash64(k))

        def keep(a, b):
            return F.lit(True)
    else:
        pivots = [r["payload"] for r in reps.orderBy(F.xxhash64("payload"), "payload").limit(METRIC_PIVOTS).collect()]
        score = checked_plugin(policy)
        carried = [f"d{k}" for k in range(len(pivots))]
        reps = cut(reps.withColumns({f"d{k}": 1 - score(F.col("payload"), F.lit(p)) for k, p in enumerate(pivots)}))
        radius = 1 - threshold + EPS
        cell = lambda k: F.floor(F.col(f"d{k}") / F.lit(max(radius, 1e-6)))
        near = [[cell(k), cell(k) + 1] for k in range(min(2, len(pivots)))]
        combined = [F.xxhash64(*c) for c in itertools.product(*near)] if pivots else [F.lit(0).cast("bigint")]
        found = F.array(*combined)

        def keep(a, b):
            return reduce(lambda x, y: x & y, [F.abs(a(c) - b(c)) <= radius + EPS for c in carried], F.lit(True))

    postings = reps.select("id", *carried, F.explode(found).alias("key"))
    block = Block(postings, carried, keep, reps.select("id", "payload"), checked_plugin(policy), threshold, merge=postings, tally=tally)
    return merging_edges(block, hot).select("src", "dst").union(stars)


def plugin_edges(df: DataFrame, policy: str, threshold: float, max_rows: int = 20_000, side: int = 256) -> DataFrame:
    """An opaque function offers nothing to block on: every pair of distinct sequences is scored.

    Blocks of rows are paired through an equi-join on the block pair. The job refuses
    tables over ``max_rows`` rather than dropping rows.
    """
    told = _DECLARED.get(policy, Declared())
    if told.keys is not None or told.metric:
        return declared_edges(df, policy, threshold)
    reps, stars = collapse(df, "payload")
    rows = reps.count()
    if rows > max_rows:
        raise ValueError(f"policy {policy!r} compares all pairs; {rows} rows exceed max_rows={max_rows}")
    blocks = max(1, math.ceil(rows / side))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    base = reps.withColumn("own", own)
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    l = base.select(F.col("id").alias("src"), F.col("payload").alias("pa"), F.col("own").alias("a"),
                    F.explode(others).alias("b"))
    r = base.select(F.col("id").alias("dst"), F.col("payload").alias("pb"), F.col("own").alias("b"),
                    F.explode(others).alias("a"))
    score = checked_plugin(policy)(F.col("pa"), F.col("pb"))
    pairs = l.join(r, ["a", "b"]).where("src < dst").withColumn("similarity", score)
    return pairs.where(F.col("similarity") >= threshold).select("src", "dst").union(stars)


def similarity_edges(df: DataFrame, id_col: str, sequence_col: str, policy: str = "canonical_kmer_jaccard",
                     threshold: float = 0.9, k: int = 8, hot: int | None = None) -> DataFrame | None:
    """Edges of a similarity policy, or None when the policy adds none (threshold 0, group policy)."""
    policy = resolve_policy(policy)
    if threshold <= 0 or policy == "customer_family_labels":
        return None
    rows = df.select(F.col(id_col).alias("id"), F.col(sequence_col).alias("payload"))
    if policy == "canonical_kmer_jaccard":
        return set_similarity_edges(rows, token_sets(policy, k), threshold, hot)
    if policy == "position_aware_motif":
        return set_similarity_edges(rows, token_sets(policy, k), threshold, hot)
    if policy == "exact_reverse_complement":
        return reverse_complement_edges(rows)
    if policy == "edit_distance":
        return edit_distance_edges(rows, threshold, hot)
    return plugin_edges(rows, policy, threshold)


def leakage_components(df: DataFrame, id_col: str, sequence_col: str, group_cols: list[str] = [],
                       policy: str = "canonical_kmer_jaccard", threshold: float = 0.9, k: int = 8,
                       hot: int | None = None) -> DataFrame:
    """(id, component) under shared group values and a similarity policy together."""
    policy = resolve_policy(policy)
    if policy == "customer_family_labels" and not group_cols:
        raise ValueError("customer_family_labels needs at least one group column")
    edges = similarity_edges(df, id_col, sequence_col, policy, threshold, k, hot)
    if group_cols:
        stars = group_edges(df, id_col, group_cols, lambda c: ~is_missing(c))
        edges = stars if edges is None else edges.union(stars)
    vertices = df.select(F.col(id_col).alias("id"))
    if edges is None:
        return vertices.withColumn("component", F.col("id"))
    return connected_components(vertices, edges)


def spanning_components(df: DataFrame, id_col: str, sequence_col: str, split_col: str, policy: str,
                        threshold: float, k: int = 8, group_cols: list[str] = []) -> DataFrame:
    """Components of train and test rows that hold both: each proves a similar pair across the split.

    The graph has only train and test rows, so a component with both must contain an
    edge from one to the other, and no pair list is needed to know it.
    """
    sides = df.where(F.col(split_col).isin("train", "test"))
    if resolve_policy(policy) == "customer_family_labels":
        comps = leakage_components(sides, id_col, sequence_col, group_cols, policy, threshold, k)
    else:
        comps = leakage_components(sides, id_col, sequence_col, [], policy, threshold, k)
    joined = comps.join(sides.select(F.col(id_col).alias("id"), split_col), "id")
    return joined.groupBy("component").agg(
        F.count_if(F.col(split_col) == "train").alias("train_rows"),
        F.count_if(F.col(split_col) == "test").alias("test_rows"),
    ).where("train_rows > 0 and test_rows > 0")


def spanning_examples(df: DataFrame, id_col: str, sequence_col: str, split_col: str, policy: str,
                      threshold: float, k: int = 8) -> DataFrame:
    """(component, train_id, test_id, similarity): one proving pair for each component with train and test rows.

    The edges that span a mixed component hold at least one from a train row to a test row,
    and every such edge is a verified pair; the smallest is shown.
    """
    sides = df.where(F.col(split_col).isin("train", "test")).select(
        F.col(id_col).alias("id"), F.col(sequence_col).alias("s"), F.col(split_col).alias("side"))
    edges = similarity_edges(sides, "id", "s", policy, threshold, k)
    if edges is None:
        raise ValueError("this policy compares no sequences")
    edges = cut(edges)
    comps = connected_components(sides.select("id"), edges)
    end = lambda name: sides.select(F.col("id").alias(name), F.col("s").alias(f"s_{name}"), F.col("side").alias(f"side_{name}"))
    crossing = edges.join(end("src"), "src").join(end("dst"), "dst").where("side_src <> side_dst")
    crossing = crossing.join(comps.withColumnRenamed("id", "src"), "src")
    first = crossing.groupBy("component").agg(F.min(F.struct("src", "dst", "s_src", "s_dst", "side_src")).alias("e"))
    train = F.col("e.side_src") == "train"
    return first.select(
        "component", F.when(train, F.col("e.src")).otherwise(F.col("e.dst")).alias("train_id"),
        F.when(train, F.col("e.dst")).otherwise(F.col("e.src")).alias("test_id"),
        pair_similarity(F.col("e.s_src"), F.col("e.s_dst"), policy, k).alias("similarity"))


def group_overlaps(df: DataFrame, split_col: str, group_cols: list[str]) -> DataFrame:
    """Group values present in both train and test; a blank value counts as a value here."""
    out = None
    for name in group_cols:
        held = df.where(F.col(name).isNotNull()).select(F.trim(F.col(name).cast("string")).alias("value"), split_col)
        values = lambda side: held.where(F.col(split_col) == side).select("value")
        both = values("train").intersect(values("test")).select(F.lit(name).alias("group_col"), "value")
        out = both if out is None else out.union(both)
    return out


# --- nearest training rows --------------------------------------------------------

#: Rarest tokens of a candidate looked up by the first round; each round looks up ``DEEPER`` times as many.
FIRST_DEPTH, DEEPER = 8, 4


@dataclass
class Search:
    """Rounds of a nearest-row search: candidates still searching and pairs compared in each."""

    rounds: list[tuple[int, int]]


def top_overlaps(candidates: DataFrame, train: DataFrame, best: int, search: Search | None = None) -> DataFrame:
    """(cand_id, train_id, similarity): the ``best`` rows of highest Jaccard per candidate, ties to the smaller training id.

    Takes (cand_id, hashed) and (train_id, hashed), token sets as arrays of hashes. All tokens have one order, the
    rarest first. A candidate looks up its rarest tokens in the inverted lists of the training rows; each new
    pair is compared whole, and the ``best``-th similarity so far is a bound that rises from round to round. A
    row not met yet shares none of the tokens looked up so far, so a pair meeting at places i and j of
    its sets has at most 1 + min(n - i, m - j) tokens in common: lists and rows that cannot reach the bound are
    left out, and a candidate ends when no unseen row can. Rows without a common token have similarity 0
    and fill up the places that are left.
    """
    both = candidates.select(F.col("cand_id").alias("c"), F.lit(None).cast(train.schema["train_id"].dataType).alias("t"), "hashed").unionByName(
        train.select(F.lit(None).cast(candidates.schema["cand_id"].dataType).alias("c"), F.col("train_id").alias("t"), "hashed"))
    ordered_sets = settle(rarest_first(settle(both.where("hashed is not null")), F.size("hashed")).select("c", "t", F.col("prefix").alias("tokens")))
    asked = ordered_sets.where("c is not null").select(F.col("c").alias("cand_id"), "tokens", F.size("tokens").alias("n"))
    sets = ordered_sets.where("t is not null").select(F.col("t").alias("train_id"), F.col("tokens").alias("others"), F.size("tokens").alias("m"))
    postings = sets.select("train_id", "m", F.posexplode("others").alias("j", "token"))
    live, known, depth = asked.withColumn("bound", F.lit(0.0)), None, 0
    first = Window.partitionBy("cand_id").orderBy(F.desc("similarity"), "train_id")
    while True:
        deeper = max(FIRST_DEPTH, depth * DEEPER)
        probes = live.select("cand_id", "n", "bound", F.posexplode(F.slice("tokens", depth + 1, deeper - depth)).alias("i", "token"))
        shared = 1 + F.least(F.col("n") - F.col("i") - depth - 1, F.col("m") - F.col("j") - 1)
        met = probes.join(postings, "token").where(shared >= F.col("bound") * (F.col("n") + F.col("m") - shared) - EPS)
        pairs = met.select("cand_id", "train_id").distinct()
        if known is not None:
            pairs = pairs.join(known.select("cand_id", "train_id"), ["cand_id", "train_id"], "left_anti")
        both = F.size(F.array_intersect("tokens", "others"))
        scored = pairs.join(asked, "cand_id").join(sets, "train_id").select(
            "cand_id", "train_id", (both / (F.col("n") + F.col("m") - both)).alias("similarity"))
        scored = settle(scored)
        if search is not None:
            search.rounds.append((live.count(), scored.count()))
        known = scored if known is None else known.unionByName(scored)
        near = settle(known.withColumn("r", F.row_number().over(first)).where(F.col("r") <= best))
        bounds = near.where(F.col("r") == best).select("cand_id", F.col("similarity").alias("reached"))
        depth = deeper
        live = live.drop("bound").join(bounds, "cand_id", "left").withColumn("bound", F.coalesce("reached", F.lit(0.0))).drop("reached")
        # an unseen row holds none of the first ``depth`` tokens: at most (n - depth) / n of the set can agree
        live = settle(live.where((F.col("n") > depth) & ((F.col("n") - depth) / F.col("n") >= F.col("bound") - EPS)))
        if live.isEmpty():
            break
    # the smallest training ids are enough to fill up: at most ``best`` of them are taken already
    spare = sets.select("train_id").orderBy("train_id").limit(2 * best)
    short = asked.select("cand_id").join(near.groupBy("cand_id").agg(F.count(F.lit(1)).alias("found")), "cand_id", "left").where(
        F.coalesce("found", F.lit(0)) < best).select("cand_id")
    fill = short.join(F.broadcast(spare)).join(near.select("cand_id", "train_id"), ["cand_id", "train_id"], "left_anti").withColumn("similarity", F.lit(0.0))
    every = near.drop("r").unionByName(fill).withColumn("r", F.row_number().over(first))
    return every.where(F.col("r") <= best).drop("r")


def nearest_training(candidates: DataFrame, train: DataFrame, k: int = 8, keep: int = 3, search: Search | None = None) -> DataFrame:
    """The ``keep`` nearest training rows of each candidate.

    The 3*keep rows with the highest k-mer Jaccard (ties to the smaller training id),
    then ordered by similarity and edit distance. Candidates are (cand_id, cand_seq),
    training rows (train_id, train_seq).
    """
    hashed = lambda name: F.transform(seq.kmers(name, k), lambda t: F.xxhash64(t)).alias("hashed")
    near = top_overlaps(candidates.select("cand_id", hashed("cand_seq")), train.select("train_id", hashed("train_seq")), 3 * keep, search)
    near = near.join(candidates.select("cand_id", "cand_seq"), "cand_id").join(train.select("train_id", "train_seq"), "train_id")
    near = near.withColumn("edit_distance", F.levenshtein("cand_seq", "train_seq"))
    last = Window.partitionBy("cand_id").orderBy(F.desc("similarity"), "edit_distance", "train_id")
    return near.withColumn("neighbor", F.row_number().over(last)).where(F.col("neighbor") <= keep).select(
        "cand_id", "neighbor", "train_id", "similarity", "edit_distance")
