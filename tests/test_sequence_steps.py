"""Per-row sequence steps against plain forms; their cost must not grow with the square of the length."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from seqaudit.functions import seq
from seqaudit.operators import corpus as cp, generate as gen

EDGE = [None, "", "A", "ACGT", "ACGTN", "äöü", "a😀c", "AC GT"]


def plain_differences(a, b):
    out = [f"{i + 1}: {x}→{y}" for i, (x, y) in enumerate(zip(a or "", b or "")) if x != y]
    return out + ([f"Length: {len(a)}→{len(b)} nt"] if a is not None and b is not None and len(a) != len(b) else [])


def test_differences_of_odd_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randrange(40)))
    rows = [(x, y) for x in EDGE for y in EDGE] + [(word(), word()) for _ in range(60)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", seq.differences("a", "b").alias("d")).collect()
    assert [r.d for r in got] == [plain_differences(r.a, r.b) for r in got]


def test_differences_of_long_texts(spark):
    texts = spark.range(4).select(F.repeat(F.lit("ACGT"), 10_000).alias("a"), F.repeat(F.lit("ACGA"), 10_000).alias("b"))
    start = time.time()
    assert {r.n for r in texts.select(F.size(seq.differences("a", "b")).alias("n")).collect()} == {10_000}
    assert time.time() - start < 30  # a split at every position would take many minutes


def test_codes_of_all_windows(spark):
    texts = [None, "", "ACG", "ACGT", "ACGTACGTTTGACA", "ACNGTAAC-", "acgt", "AC😀GTACG"]
    for k in (1, 3, 6):
        got = spark.createDataFrame([(t,) for t in texts], "s string").select(
            "s", seq.kmer_codes("s", k).alias("c"), F.transform(F.when(F.length("s") >= k, F.sequence(F.lit(1), F.length("s") - k + 1)).otherwise(
                F.array().cast("array<int>")), lambda i: seq.kmer_code(F.substr("s", i, F.lit(k)))).alias("w")).collect()
        assert [r.c for r in got] == [None if r.s is None else r.w for r in got]


def test_masked_spans_follow_the_digests(spark):
    share, span, seed = 0.2, 5, 8
    rows = [(k, [j % 4 for j in range(n)]) for k, n in enumerate((0, 1, 4, 5, 6, 23, 200, 4000))] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    start = time.time()
    got = {r.id: r.masked_ids for r in cp.mask_spans(df, "id", "ids", share, span, seed).collect()}
    assert time.time() - start < 30  # 4,000 positions that each went through 800 cells would take minutes
    for k, ids in rows:
        if ids is None:
            assert got[k] is None
            continue
        cells = sorted(range(max(1, -(-len(ids) // span))), key=lambda c: hashlib.md5(f"{seed}:{k}:{c}".encode()).hexdigest())
        left, want = max(1, int(len(ids) * share + 0.5)), list(ids)
        turn = {c: p * span for p, c in enumerate(cells)}
        want = [4 if turn[i // span] + i % span < left else x for i, x in enumerate(ids)]
        assert got[k] == want


def test_mutation_profile_against_a_plain_count(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    rows = [(k, word(n), word(n)) for k, n in enumerate(rng.randrange(12) for _ in range(80))] + [(90, "ACG", "AC"), (91, None, "A"), (92, "NN", "AC")]
    per, at = gen.mutation_profile(spark.createDataFrame(rows, "id long, p string, s string"), "id", "p", "s")
    sites, counts = {}, {}
    for k, p, s in rows:
        if p is None or len(p) != len(s):
            continue
        for i, (x, y) in enumerate(zip(list(p) or [""], list(s) or [""])):
            if x != "N":
                counts[k] = counts.get(k, 0) + (x != y)
                sites.setdefault(i + 1, []).append(x != y)
    assert {r.id: r.mutations for r in per.collect()} == counts
    assert {r.position: (round(r.rate, 9), r["rows"]) for r in at.collect()} == {i: (round(sum(v) / len(v), 9), len(v)) for i, v in sites.items()}


def test_mutation_profile_of_long_parents(spark):
    texts = spark.range(4).select("id", F.repeat(F.lit("ACGT"), 10_000).alias("p"), F.repeat(F.lit("ACGA"), 10_000).alias("s"))
    start = time.time()
    _, at = gen.mutation_profile(texts, "id", "p", "s")
    assert at.agg(F.sum("rows"), F.sum("rate")).first() == (160_000, 10_000.0)
    assert time.time() - start < 30  # 40,000 copies of each parent would be over 100 GB
