"""Operators 11 to 13 against brute force and on edge rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqaudit.llm import hard_negatives, importance_resampling as resampling, queries, token_counts
from seqaudit.session import cut, read

from test_llm_operators import DOCS, EDGE

SF = "/root/testdata/sf0.001"


# 11 importance resampling

def brute_features(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [" ".join(p) for p in zip(words, words[1:])]]


def brute_resample(rows, items, least=20):
    own, want = np.zeros(10000, int), np.zeros(10000, int)
    found = [(i, *brute_features(t)) for i, t in rows]
    for _, _, f in found:
        np.add.at(own, f, 1)
    for t in items:
        np.add.at(want, brute_features(t)[1], 1)
    gain = [math.floor(1000 * math.log((t + 1) * (own.sum() + 10000) / ((s + 1) * (want.sum() + 10000)))) for s, t in zip(own, want)]
    out = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, n >= least and i is not None])
    judged = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0], -r[1]))
    ranks = {id(r): k for k, r in enumerate(judged[:25 * len(judged) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def listed(df):
    return sorted((tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    got = queries.op11_importance_resampling(spark, SF).withColumnRenamed("doc_id", "id")
    assert listed(got) == sorted(brute_resample(docs, items), key=str)


def test_resampling_edges(spark):
    """Nulls, empty and long texts, repeated rows, a missing id, clashing columns, empty tables."""
    edge = [*EDGE, *[(100 + k % 7, f"Ünïcode {k % 3} WORDS of " + "some more words " * 9, "en", "s", 1) for k in range(60)]]
    docs = spark.createDataFrame(edge, DOCS).withColumns({n: F.lit(1) for n in ("score", "rank", "mark", "id", "weight")})
    items = spark.createDataFrame([(1, "unïcode words"), (2, None), (2, "")], "item_id bigint, text string")
    got = resampling.resample(docs, items)
    assert listed(got) == sorted(brute_resample([r[:2] for r in edge], ["unïcode words", None, ""]), key=str)
    assert resampling.resample(docs.limit(0), items).count() == 0
    assert resampling.resample(docs, items.limit(0)).where("rank is not null").count() > 0


def test_quickselect_finds_every_place_among_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice([-5, 0, 0, 0, 9]), rng.randrange(4), k) for k in range(400)]
    keys = cut(spark.createDataFrame(rows, "a bigint, b bigint, c bigint"))
    want = sorted(rows)
    for k in (1, 2, 133, 250, 399, 400):
        assert resampling.kth_key(keys, k, pivots=5, seed=k) == want[k - 1]
    assert resampling.kth_key(keys, 401) is None and resampling.kth_key(keys, 0) is None
    assert resampling.kth_key(keys.limit(0), 1) is None


def test_draw_follows_the_target(spark):
    """Documents that speak like the target are drawn far more often than the others."""
    rows = [(k, ("alpha beta gamma " if k % 4 == 0 else "one two three ") * 10, "en", "s", 1) for k in range(400)]
    target = spark.createDataFrame([(1, "alpha beta gamma " * 500)], "item_id bigint, text string")
    drawn = resampling.resample(spark.createDataFrame(rows, DOCS), target).where("rank is not null").collect()
    assert len(drawn) == 100 and sum(r.id % 4 == 0 for r in drawn) >= 90
    assert sorted(r["rank"] for r in drawn) == list(range(1, 101))


# 12 token counts

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_token_counts_match_the_library(spark, tokenizer):
    texts = {r.doc_id: r.text or "" for r in read(spark, SF, "documents").collect()}
    got = queries.op12_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_token_counts_of_odd_texts(tokenizer):
    counter = token_counts.TokenCounter(str(public_tokenizers.path("byte_bpe_50k.json")), {" the": 1})
    rng = random.Random(5)
    alphabet = ["a", "Z", "é", "ß", "я", "中", "가", "٣", "7", "½", "'s", "'", "ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ",
                "　", "​", "<|endoftext|>", "<|", ".", "--", "😀", "̈", "ア", "ー", "²", " the", "\x00", "️", "𝒳"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 25))) for _ in range(20_000)]
    texts += ["", " ", "a" * 50_000, " " * 5_000 + "x", "\n" * 3_000, "word " * 20_000]
    for t in texts:
        assert counter.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), repr(t)


def test_split_agrees_for_every_plain_character(tokenizer):
    """Each character that is split here is split as the library does, whatever stands beside it."""
    plain = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if not token_counts._STRANGE.search(c)]
    assert len(plain) > 30_000
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for at in range(0, len(plain), 500):
        text = "".join(f"a{c}1{c}.{c} {c}" for c in plain[at:at + 500])
        ends = [e for _, (_, e) in split(text)]
        assert np.cumsum([len(p) for p in token_counts._SPLIT.findall(text)]).tolist() == ends


def test_token_count_edges(spark, tokenizer):
    edge = spark.createDataFrame([*EDGE, (9, "x<|endoftext|>y 'tis", "en", "s", 1)], DOCS)
    got = token_counts.token_counts(edge.withColumns({"n_tokens": F.lit(1), "id": F.lit(2)})).collect()
    want = [(r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in
            [*EDGE, (9, "x<|endoftext|>y 'tis")]]
    assert sorted(((r.id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(edge.limit(0)).count() == 0


def test_table_and_misses_give_the_same_counts(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    docs = read(spark, SF, "documents")
    table = token_counts.frequent(docs, path)
    assert table and token_counts.unpacked(token_counts.packed(table)) == table
    with_table, without = token_counts.TokenCounter(path, table), token_counts.TokenCounter(path)
    for r in docs.limit(50).collect():
        assert with_table.count(r.text) == without.count(r.text)
    assert with_table.missed < without.missed / 2


# 13 hard negatives

def brute_negatives(rows, asks, positives=5, negatives=5, low=80, high=100):
    def good(x):
        return x is not None and all(v is not None and math.isfinite(v) for v in x)

    live = [(i, label, [max(-2 ** 20, min(2 ** 20, math.floor(256 * v))) for v in x]) for i, label, x in rows
            if i is not None and label is not None and good(x)]
    anchors = {}
    for i, label, x in live:
        if asks(i):
            anchors[i] = min(anchors.get(i, (label, x)), (label, x))
    out = set()
    for a, (label, x) in anchors.items():
        scored = sorted({(-sum(p * q for p, q in zip(x, y)), i, other == label) for i, other, y in live if i != a})
        for p, i, same in [r for r in scored if r[2]][:positives]:
            fits = [r for r in scored if not r[2] and low * -p <= 100 * -r[0] <= high * -p][:negatives]
            out |= {(a, i, k, n, -p, -s) for k, (s, n, _) in enumerate(fits, 1)}
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def made(spark, rows):
    return spark.createDataFrame([(i, x, label) for i, label, x in rows], VECTORS)


def tuples(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def test_negatives_match_brute_force(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    assert tuples(queries.op13_hard_negatives(spark, SF)) == brute_negatives(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("block", [4096, 3])
def test_negatives_among_ties_and_overlapping_windows(spark, block):
    """Few distinct small vectors: most scores and limits tie, windows overlap; also in several anchor blocks."""
    rng = random.Random(block)
    grid = [0.0, 0.25, 0.5, 1.0, -0.5]
    rows = [(k, rng.randrange(3), [rng.choice(grid) for _ in range(3)]) for k in range(300)]
    rows += [(k, k % 2, [1.0, 1.0, 0.5]) for k in range(300, 700)]  # one vector of more than half of all rows
    got = hard_negatives.mine(made(spark, rows).repartition(5), F.col("vec_id") % 40 == 0, block=block)
    want = brute_negatives(rows, lambda i: i % 40 == 0)
    assert tuples(got) == want and len(want) > 200


def test_negative_edges(spark):
    """Null and non-finite parts, lengths that differ, repeated ids, huge values, clashing columns, empty tables."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.9]), (3, 2, [1.0, 0.5]),
            (3, 2, [1.0, 0.5]), (4, 2, [0.95, 0.5, 3.0]), (5, 3, []), (6, None, [1.0]), (7, 2, None), (8, 2, [None, 1.0]), (9, 2, [nan, 1.0]),
            (10, 2, [inf, 1.0]), (None, 2, [1.0, 0.5]), (100, 2, [1e30, -1e30]), (101, 2, [1e30, -1e30]), (102, 3, [1e30, -1e30]), (200, 5, [0.0])]
    df = made(spark, rows)
    asks = F.col("vec_id") % 100 == 0
    want = brute_negatives(rows, lambda i: i % 100 == 0)
    assert want and tuples(hard_negatives.mine(df.withColumns({"id": F.lit(1), "x": F.lit(2), "score": F.lit(3)}), asks)) == want
    assert tuples(hard_negatives.mine(df.limit(0), asks)) == []
    assert tuples(hard_negatives.mine(df, F.lit(False))) == []
