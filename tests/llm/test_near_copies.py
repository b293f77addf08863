"""Near copies at 5-word Jaccard 0.8 against brute force over all pairs."""

import itertools

from pyspark.sql import functions as F

import corpus_pipeline
from seqaudit.llm import near_copies
from seqaudit.session import read

from test_llm_operators import DOCS, EDGE


def grams(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_least(rows):
    """Smallest id of each id's group, and the pairs of ids with different sets at 0.8 or more."""
    sets = {}
    for i, t in rows:
        sets.setdefault(grams(t), []).append(i)
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    held, pairs = {}, 0
    for s in sets:
        for g in s:
            held.setdefault(g, set()).add(s)
    met = {frozenset(p) for h in held.values() if len(h) > 1 for p in itertools.combinations(h, 2)}
    for a, b in map(tuple, met):
        if len(a & b) * 5 >= len(a | b) * 4:
            pairs += len(sets[a]) * len(sets[b])
            parent[root(a)] = root(b)
    low = {}
    for s, ids in sets.items():
        low[root(s)] = min(low.get(root(s), min(ids)), min(ids))
    return {i: low[root(s)] for s, ids in sets.items() for i in ids}, pairs


def test_documents_match_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    want, pairs = brute_least([tuple(r) for r in docs.collect()])
    assert pairs >= 12
    got = {r.id: r.component_id for r in near_copies.groups(docs).collect()}
    assert got == want


def test_stage_drops_a_copy_many_bits_away(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("doc_id in (56, 467, 255, 615)")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [56, 255]


def test_edges(spark):
    edge = spark.createDataFrame(EDGE, DOCS)
    kept = near_copies.keep_one(edge.withColumn("more", F.lit(1)))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6] and kept.columns == [*edge.columns, "more"]
    assert near_copies.keep_one(edge.limit(0)).count() == 0


def test_pipeline_stage_keeps_one_of_each_brute_force_group(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    want, _ = brute_least([(r.doc_id, r.text) for r in docs.collect()])
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, low in want.items() if i == low)


def _copies(n, words, changed, seed):
    import random
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(words), changed):
            text[at] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(text))
    return out


def test_hot_group_with_strangers(spark, monkeypatch):
    """A large group of near copies, texts that share half of it, and crowded keys cut into blocks: as brute force finds it."""
    monkeypatch.setattr(near_copies, "PROBES", 7)
    monkeypatch.setattr(near_copies, "MEMBERS", 25)
    group = _copies(160, 120, 1, 1)
    half = [" ".join(group[0].split()[:70] + t.split()[:50]) for t in _copies(40, 60, 60, 2)]
    rows = [(k, t) for k, t in enumerate([*group, *half, *_copies(12, 80, 1, 3), *_copies(30, 50, 50, 4), *group[:20]])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want, pairs = brute_least(rows)
    assert pairs > 500
    for shared, dense in ((near_copies.SHARED_KEYS, 4), (0, 4), (0, 0), (0, 10 ** 9)):  # the layout broadcast or joined; blocks whole or by pairs
        monkeypatch.setattr(near_copies, "SHARED_KEYS", shared)
        monkeypatch.setattr(near_copies, "DENSE", dense)
        assert {r.id: r.component_id for r in near_copies.groups(docs).collect()} == want


def test_rows_compared_grow_with_texts_not_with_a_group(spark, monkeypatch):
    """Pairs and block rows brought to verification stay the same a text when a group is four times as large, be it just alike enough or not."""
    moved = []
    pairs, blocks = near_copies._verified, near_copies._verified_blocks
    monkeypatch.setattr(near_copies, "_verified", lambda p, s: moved.append(p.count()) or pairs(p, s))
    monkeypatch.setattr(near_copies, "_verified_blocks", lambda r, s: moved.append(r.count()) or blocks(r, s))
    for changed, one in ((2, True), (7, False)):  # the latter are alike at about 0.63 to 0.75
        counts = []
        for n in (100, 400):
            moved.clear()
            docs = spark.createDataFrame(list(enumerate(_copies(n, 300, changed, n))), "doc_id bigint, text string")
            assert (near_copies.keep_one(docs).count() == 1) == one
            counts.append(sum(moved) / n)
        assert counts[1] <= 1.5 * counts[0] + 1 and counts[1] <= 30


def test_joining_links_of_a_block():
    import numpy as np

    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(12, 112, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    assert near_copies.joining_links([1, 2, 3, 4], [1, 2, 3, 4], sets) in ([(2, 1), (2, 3)], [(2, 1), (3, 2)], [(1, 2), (2, 3)], [(1, 2), (3, 2)])
    assert near_copies.joining_links([1, 2, 3], [7, 7, 7], sets[:3]) == []
    assert near_copies.joining_links([1, 2], [1, 2], [np.zeros(0, np.uint64)] * 2) in ([], [(2, 1)], [(1, 2)])
