"""Similarity components against brute force, split rule against its sequential form."""

import hashlib
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqaudit.functions import seq
from seqaudit.operators import candidates, similarity as sim, split as sp
from seqaudit.operators.components import connected_components


def components(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def as_map(df):
    return {r["id"]: r["component"] for r in df.collect()}


def token_components(spark, sets, t, hot=None):
    rows = [(i, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, payload array<string>")
    edges = sim.set_similarity_edges(df, lambda c: c, t, hot)
    return as_map(connected_components(df.select("id"), edges))


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8])
def test_all_subsets_match_brute_force(spark, threshold):
    sets = [set(c) for n in range(6) for c in itertools.combinations("abcde", n)]
    pairs = [(i, j) for i, j in itertools.combinations(range(32), 2) if jac(sets[i], sets[j]) >= threshold]
    assert token_components(spark, sets, threshold) == components(pairs, range(32))


def test_near_copy_group_and_strangers_with_small_shares(spark, monkeypatch):
    monkeypatch.setattr(sim, "PAIRS_PER_POSTING", 0)
    rnd = random.Random(3)
    base = [f"t{i}" for i in range(60)]
    sets = [set(base) | {f"own{i}"} for i in range(40)] + [set(rnd.sample([f"r{i}" for i in range(90)], 40)) for _ in range(20)]
    for s in list(sets[40:50]):
        drifted = set(s)
        drifted.pop()
        sets.append(drifted)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jac(sets[i], sets[j]) >= 0.9]
    assert token_components(spark, sets, 0.9, hot=4) == components(pairs, range(len(sets)))


def test_exact_boundary_pair_is_kept(spark):
    a = {f"x{i}" for i in range(9)}
    assert len(set(token_components(spark, [a, a | {"y"}], 0.9).values())) == 1


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_edit_distance_components(spark, threshold):
    rnd = random.Random(5)
    seqs = []
    for _ in range(12):
        s = "".join(rnd.choice("ACGT") for _ in range(rnd.choice([1, 3, 10, 20, 41])))
        seqs.append(s)
        for _ in range(3):
            t = list(s)
            for _ in range(rnd.randint(1, 4)):
                at = rnd.randrange(len(t)) if t else 0
                kind = rnd.random()
                if kind < 0.4 and t:
                    t[at] = rnd.choice("ACGT")
                elif kind < 0.7 and len(t) > 1:
                    del t[at]
                else:
                    t.insert(at, rnd.choice("ACGT"))
            seqs.append("".join(t))
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, payload string")
    pairs = [(i, j) for i, j in itertools.combinations(range(len(seqs)), 2)
             if 1 - levenshtein(seqs[i], seqs[j]) / max(len(seqs[i]), len(seqs[j]), 1) >= threshold - 1e-12]
    got = as_map(connected_components(df.select("id"), sim.edit_distance_edges(df, threshold, hot=3)))
    assert got == components(pairs, range(len(seqs)))


def test_known_pairs(spark):
    df = spark.createDataFrame([("AAGTCCGA", "TCGGACTT"), ("AAAACCCC", "CCCCAAAA")], "a string, b string")
    row = df.select(sim.pair_similarity("a", "b", "exact_reverse_complement").alias("rc"),
                    sim.pair_similarity("a", "b", "kmer_jaccard", 3).alias("k"), sim.pair_similarity("a", "b", "edit_distance").alias("e")).collect()
    assert row[0]["rc"] == 1.0 and row[1]["k"] > 0.30 and row[1]["e"] < 0.30


def test_policy_registry():
    assert sim.register_similarity_policy("My policy", lambda a, b: a) == "my_policy"
    with pytest.raises(ValueError):
        sim.register_similarity_policy("my-policy", lambda a, b: a)
    for name in ("edit_distance", "kmer_cosine", "9x"):
        with pytest.raises(ValueError):
            sim.register_similarity_policy(name, lambda a, b: a)
    assert sim.registered_similarity_policies() == ("my_policy",)
    assert sim.unregister_similarity_policy("my_policy") and not sim.unregister_similarity_policy("my_policy")
    with pytest.raises(ValueError):
        sim.resolve_policy("edit_distance", "kmer_jaccard")


def test_plugin_out_of_range_fails(spark):
    sim.register_similarity_policy("too_big", lambda a, b: pd.Series([2.0] * len(a)), replace=True)
    df = spark.createDataFrame([(1, "AC"), (2, "GT")], "id long, s string")
    with pytest.raises(Exception, match="must return values"):
        sim.leakage_components(df, "id", "s", policy="too_big", threshold=0.5).collect()
    sim.unregister_similarity_policy("too_big")


def test_missing_groups_never_join(spark):
    rows = [(0, "AAAA", "d1", "b1"), (1, "CCCC", "d1", "b2"), (2, "GGGG", "d2", "b2"), (3, "TTTT", None, ""), (4, "ACAC", "", None), (5, "AGAG", "nan", "b9")]
    df = spark.createDataFrame(rows, "id long, sequence string, donor string, batch string")
    got = as_map(sim.leakage_components(df, "id", "sequence", ["donor", "batch"], threshold=0))
    assert got[0] == got[1] == got[2] and len(set(got.values())) == 4


def pop_loop(clusters, n, val, test, seed=13):
    """Sequential form: pop from the smallest end while a split is not full."""
    order = sorted(clusters, key=lambda c: (-c[1], hashlib.sha256(f"{seed}:{c[2]}".encode()).hexdigest()))
    out, size = {}, {"test": 0, "val": 0}
    for name, share in (("test", test), ("val", val)):
        want = max(1, round(n * share)) if len(clusters) >= 3 and share > 0 else round(n * share)
        while want > 0 and len(order) > 1 and size[name] < want:
            c = order.pop()
            out[c[0]] = name
            size[name] += c[1]
    return {c[0]: out.get(c[0], "train") for c in clusters}


def test_cluster_fill_equals_pop_loop(spark, monkeypatch):
    from seqaudit.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 20)
    rnd = random.Random(9)
    for n_clusters in (1, 2, 5, 90):
        clusters = [(i, rnd.choice([1, 1, 1, 2, 3, 8]), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n_clusters)]
        n = sum(c[1] for c in clusters)
        df = spark.createDataFrame(clusters, "component long, size long, fingerprint string")
        got = sp.assign_clusters(df, n, n_clusters, 0.15, 0.2, 13)
        assert {r["component"]: r["split"] for r in got.collect()} == pop_loop(clusters, n, 0.15, 0.2)


def test_split_ignores_row_order_and_large_clusters(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(40)), f"g{i % 7}") for i in range(42)]
    cols = "id long, sequence string, grp string"
    a = sp.leakage_safe_split(spark.createDataFrame(rows, cols), "id", "sequence", ["grp"])
    b = sp.leakage_safe_split(spark.createDataFrame(rows[::-1], cols), "id", "sequence", ["grp"])
    key = lambda d: sorted((r["id"], r["leakage_cluster"], r["split"]) for r in d.collect())
    assert key(a) == key(b)
    by_group = {}
    for r in a.collect():
        by_group.setdefault(r["id"] % 7, set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values())


def test_nearest_training_matches_brute_force(spark):
    rnd = random.Random(2)
    make = lambda n: ["".join(rnd.choice("ACGT") for _ in range(30)) for _ in range(n)]
    train = make(60)
    cand = make(3) + [train[4], train[7][:29] + "A"]
    near = sim.nearest_training(spark.createDataFrame(list(enumerate(cand)), "cand_id long, cand_seq string"),
                                spark.createDataFrame(list(enumerate(train)), "train_id long, train_seq string"))
    got = {(r["cand_id"], r["neighbor"]): r["train_id"] for r in near.collect()}
    toks = lambda s: candidates._tokens(s, 8, False)
    for i, c in enumerate(cand):
        nine = sorted(range(60), key=lambda j: (-jac(toks(c), toks(train[j])), j))[:9]
        three = sorted(nine, key=lambda j: (-jac(toks(c), toks(train[j])), levenshtein(c, train[j]), j))[:3]
        assert [got[(i, k)] for k in (1, 2, 3)] == three


def test_kmers_match_definition(spark):
    texts = ["ACGTACGTTGCA", "ACGNNACGTACGTA", "ACG", "", "NNNNNNNNN"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [set(r["k"]) for r in df.select(seq.kmers("s", 4).alias("k")).collect()]
    assert got == [candidates._tokens(t, 4, False) for t in texts]
    pos = [set(r["k"]) for r in df.select(seq.positional_kmers("s", 4).alias("k")).collect()]
    assert pos == [{f"{i}:{w}" for i, w in candidates._tokens(t, 4, True)} for t in texts]
