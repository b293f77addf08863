"""Coded k-mer sets hold the tokens of the column functions, and similar sets meet under an equal part."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqaudit.functions import seq
from seqaudit.functions.token_sets import CodedSets, coded, most_apart, part_keys
from seqaudit.operators import similarity as sim
from seqaudit.operators.components import connected_components
from seqaudit.operators.nested import cut_at, nested_edges


def mutated(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        if letters:
            letters[rng.randrange(len(letters))] = rng.choice("ACGT")
    return "".join(letters)[rng.randrange(4):]


def texts(seed=5):
    rng = random.Random(seed)
    out = ["", "A", "ACGTACG", "CGTACGT", "ACGNACGT", "NNNNNNNNNN", "A" * 40, "T" * 60, "acgtacgtacgt", "ACGTéACGTACGTTTG", "AC\nGTACGTACGTAC"]
    for n in (8, 9, 15, 30, 60, 127, 130, 200, 260):
        base = "".join(rng.choice("ACGT") for _ in range(n))
        out += [base, base, *[mutated(rng, base, e) for e in (0, 1, 1, 2, 3, 5)]]
    return out + ["".join(rng.choice("ACGTN") for _ in range(50)) for _ in range(4)]


def plain(spark, rows, places, k=8):
    df = spark.createDataFrame(list(enumerate(rows)), "id long, s string")
    fn = seq.positional_kmers if places else seq.kmers
    return {r["id"]: set(r["t"]) for r in df.select("id", fn("s", k).alias("t")).collect()}


def index(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("places", [False, True])
def test_codes_are_the_tokens(spark, places):
    rows = [*texts(), None]
    want = plain(spark, rows, places)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, s string")
    sets = CodedSets(8, places)
    got = {r["id"]: r for r in df.select("id", sets("s").alias("c"), sets.digest("s").alias("d"), sets.summary("s").alias("s")).collect()}
    for i, tokens in want.items():
        codes = got[i]["c"]
        assert codes == sorted(set(codes)) == got[i]["s"]["hashed"] and len(codes) == len(tokens)
        for j in want:
            assert len(tokens & want[j]) == len(set(codes) & set(got[j]["c"]))
            assert (tokens == want[j]) == (got[i]["d"] == got[j]["d"])
        bits = {c & 255 for c in codes}
        assert all(got[i]["s"][f"w{w}"] & (2**64 - 1) == sum(1 << (b - 64 * w) for b in bits if b // 64 == w) for w in range(4))


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95, 1.0])
@pytest.mark.parametrize("places", [False, True])
def test_similar_sets_share_an_asked_part(threshold, places):
    counts, codes = coded(texts(), 8, places)
    sets = [set(p.tolist()) for p in np.split(codes, np.cumsum(counts)[:-1])]
    (nh, held), (na, asked) = part_keys(counts, codes, threshold)
    held, asked = (np.split(v, np.cumsum(n)[:-1]) for v, n in ((held, nh), (asked, na)))
    assert all(len(a) == (most_apart(np.array([len(s)]), threshold)[0] + 1 if s else 0) for a, s in zip(asked, sets))
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if sets[j] and len(sets[i]) >= len(sets[j]) and index(sets[i], sets[j]) >= threshold]
    assert len(pairs) > len(sets)
    assert all(set(asked[i].tolist()) & set(held[j].tolist()) for i, j in pairs)


def brute(rows, sets, t):
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if index(sets[i], sets[j]) >= t - 1e-9:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    return dict(enumerate(parent))


@pytest.mark.parametrize("policy, hot", [("canonical_kmer_jaccard", 2), ("position_aware_motif", None)])
def test_components_equal_brute_force(spark, policy, hot):
    rows = texts(11)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, s string")
    edges = sim.similarity_edges(df, "id", "s", policy, 0.8, 8, hot)
    got = {r["id"]: r["component"] for r in connected_components(df.select("id"), edges).collect()}
    assert got == brute(rows, plain(spark, rows, policy == "position_aware_motif"), 0.8)


def test_nested_components_equal_brute_force(spark):
    rows = texts(12)[:60]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, s string")
    edges = nested_edges(df, "id", "s", [0.8, 0.95])
    got = {r["id"]: r["component"] for r in connected_components(df.select("id"), cut_at(edges, 0.8)).collect()}
    assert got == brute(rows, plain(spark, rows, False), 0.8)


def test_two_rows_of_one_part_only_are_no_pair(spark):
    """The keys of a row grow with its tokens, not with their pairs, and unlike rows hardly meet."""
    rng = random.Random(3)
    rows = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, payload string")
    block = sim.SetTable(df, sim.token_sets("canonical_kmer_jaccard", 8), 0.8).block(0.8)
    labelled = block.sets.withColumn("component", F.col("id"))
    asked, held = (block.parts(labelled, side) for side in (True, False))
    assert held.count() <= 60 * len(rows) and asked.count() <= 45 * len(rows)
    assert sim.piece_pairs(asked, held, 512, block.keep).count() == 0
