"""Operators of round three against brute force: nested linkage, top-k set join, pivots, growing radius, digests, draws, streams."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqaudit.functions import seq
from seqaudit.operators import corpus as cp, distances, metric, nested, similarity as sim
from seqaudit.operators.components import connected_components
from seqaudit.session import cut
from seqaudit.sources import digests, tables
from seqaudit.streaming import stream


def family(rng, size, length, changes, base=None):
    base = base or "".join(rng.choice("ACGT") for _ in range(length))
    out = []
    for _ in range(size):
        s = list(base)
        for at in rng.sample(range(len(s)), changes):
            s[at] = rng.choice("ACGT")
        out.append("".join(s))
    return out


# nested single linkage

def test_nested_components_equal_separate_searches(spark):
    rng = random.Random(4)
    texts = [t for k in range(12) for t in family(rng, 12, 200, 1 + k // 2)] + family(rng, 30, 200, 200) + ["ACGT" * 50] * 5
    df = cut(spark.createDataFrame(list(enumerate(texts)), "row long, s string"))
    levels = [0.6, 0.7, 0.8, 0.9, 0.95]
    edges = nested.nested_edges(df, "row", "s", [levels[0], levels[-1]])
    seen = set()
    for t in levels:
        got = connected_components(df.select(F.col("row").alias("id")), nested.cut_at(edges, t))
        want = sim.leakage_components(df, "row", "s", threshold=t)
        got, want = ({r.id: r.component for r in x.collect()} for x in (got, want))
        assert got == want
        seen.add(len(set(want.values())))
    assert len(seen) >= 4  # the thresholds differ in what they join


def test_spanning_forest_keeps_every_cut(spark):
    rng = random.Random(9)
    edges = [(a, b, rng.choice([0.5, 0.6, 0.6, 0.7, 0.9])) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150))]
    forest = [tuple(r) for r in nested.maximum_spanning_forest(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()]

    def parts(pairs):
        up = list(range(60))
        for a, b, *_ in pairs:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        find = lambda v: v if up[v] == v else find(up[v])
        return [find(v) for v in range(60)]

    for t in (0.5, 0.6, 0.7, 0.9):
        assert parts(e for e in edges if e[2] >= t) == parts(e for e in forest if e[2] >= t)
    assert len(forest) == 60 - len(set(parts(edges)))


# nearest training rows

def brute_top(cands, train, best):
    toks = lambda s: {min(s[i:i + 8], s[i:i + 8][::-1].translate(str.maketrans("ACGT", "TGCA"))) for i in range(len(s) - 7)}
    sets = {j: toks(t) for j, t in train.items()}
    out = {}
    for i, c in cands.items():
        own = toks(c)
        out[i] = sorted((round(-len(own & s) / len(own | s), 12), j) for j, s in sets.items())[:best]
    return out


def test_top_overlaps_with_ties_and_without_overlap(spark):
    rng = random.Random(2)
    train = dict(enumerate(family(rng, 40, 60, 3) + family(rng, 40, 60, 8) + family(rng, 60, 60, 60) + ["A" * 60] * 6))
    cands = dict(enumerate([train[3], train[50], "A" * 60, "".join(rng.choice("CG") for _ in range(60)), *family(rng, 4, 60, 60)]))
    hashed = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} long, s string").select(
        name, F.transform(seq.kmers("s", 8), lambda t: F.xxhash64(t)).alias("hashed"))
    got = sim.top_overlaps(hashed(cands, "cand_id"), hashed(train, "train_id"), 9)
    rows = collections.defaultdict(list)
    for r in got.collect():
        rows[r.cand_id].append((round(-r.similarity, 12), r.train_id))
    assert {i: sorted(v) for i, v in rows.items()} == brute_top(cands, train, 9)


def test_top_overlaps_compares_few_pairs_of_growing_tables(spark):
    """Each candidate has a family of its own: pairs compared grow with the rows, not with their product."""
    shares = []
    for families in (10, 40):
        rng = random.Random(families)
        bases = [family(rng, 1, 80, 0)[0] for _ in range(families)]
        train = [t for b in bases for t in family(rng, 15, 80, 2, b)]
        cands = [family(rng, 1, 80, 2, b)[0] for b in bases]
        search = sim.Search([])
        make = lambda texts, name: spark.createDataFrame(list(enumerate(texts)), f"{name}_id long, {name}_seq string")
        near = sim.nearest_training(make(cands, "cand"), make(train, "train"), search=search).collect()
        assert all(r.train_id // 15 == r.cand_id for r in near) and len(near) == 3 * families
        shares.append(sum(p for _, p in search.rounds) / families)
        assert search.rounds[-1][0] <= families
    assert shares[1] <= 1.5 * shares[0]


# nearest cosine

def brute_cosine(vectors):
    x = np.array(list(vectors.values()), float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.where(n < 1e-9, 0.0, x / np.where(n < 1e-9, 1, n))
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return dict(zip(vectors, s.max(axis=1)))


@pytest.mark.parametrize("share", [4096, 9])
def test_nearest_cosine_is_exact_and_visits_few_cells(spark, share):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(25, 16))
    rows = {k: (centers[k % 25] + 0.1 * rng.normal(size=16)).tolist() for k in range(1000)}
    rows |= {1000 + k: [1.0] + [0.5] * 15 for k in range(300)} | {1300: [0.0] * 16, 1301: [0.0] * 16, 1302: (-centers[0]).tolist()}
    df = spark.createDataFrame(list(rows.items()), "v long, x array<double>").repartition(4)
    rounds = metric.Rounds()
    got = {r.id: (r.neighbor, r.similarity) for r in metric.nearest_cosine(df, "v", "x", pivots=31, share=share, rounds=rounds).collect()}
    want = brute_cosine(rows)
    assert got.keys() == want.keys()
    for k, (other, value) in got.items():
        a, b = np.array(rows[k]), np.array(rows[other])
        assert other != k and abs(value - want[k]) < 1e-9
        assert abs(a @ b / max(1e-9, np.linalg.norm(a) * np.linalg.norm(b)) - value) < 1e-9
    visits = sum(v for _, v in rounds.visits)
    assert visits < 0.6 * rounds.cells * 1003 and len(rounds.visits) > 1


def test_nearest_cosine_of_few_rows(spark):
    df = lambda rows: spark.createDataFrame(rows, "v long, x array<double>")
    find = lambda rows: {r.id: (r.neighbor, r.similarity) for r in metric.nearest_cosine(df(rows), "v", "x").collect()}
    assert find([]) == {} and find([(1, [1.0, 0.0])]) == {}
    assert find([(1, [1.0, 0.0]), (2, [-1.0, 0.0])]) == {1: (2, -1.0), 2: (1, -1.0)}
    assert find([(1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [4.0, 0.0]), (None, [1.0, 1.0]), (5, None)]) == {1: (3, 1.0), 2: (3, 1.0), 3: (2, 1.0)}
    assert find([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])]) == {1: (3, 0.0), 2: (3, 0.0), 3: (2, 0.0)}


# nearest edit distance

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_min_edit_distance_by_growing_radius(spark):
    rng = random.Random(8)
    refs = family(rng, 60, 40, 40) + ["AC", "A", ""]
    rows = []
    for k in range(120):
        s = list(refs[k % 60])
        for _ in range(k % 13):
            at = rng.randrange(len(s))
            s[at:at + 1] = rng.choice([[], [rng.choice("ACGT")], [s[at], rng.choice("ACGT")]])
        rows.append((k, "".join(s)))
    rows += [(120, ""), (121, None), (122, "T" * 40), (123, refs[0]), (124, refs[0])]
    df = spark.createDataFrame(rows, "row long, s string")
    held = spark.createDataFrame([(r,) for r in refs + refs[:5]], "r string")
    tally = []
    got = {r.row: r.d for r in distances.min_edit_distance(df, "row", "s", held, "r", "d", block_chars=500, tally=tally).collect()}
    assert got == {k: None if s is None else min(levenshtein(s, r) for r in refs if r) for k, s in rows}
    searching = {radius: n for radius, n, _ in tally}
    assert list(searching) == [1, 2, 4, 8, -1] and searching[1] > searching[4] > searching[8] > searching[-1]
    # under the first radii hardly any of the row x reference pairs is compared
    assert tally[0][2] < 0.2 * searching[1] * 62 and tally[1][2] < 0.2 * searching[2] * 62


def test_min_edit_distance_without_references(spark):
    df = spark.createDataFrame([(1, "ACGT"), (2, "")], "row long, s string")
    none = spark.createDataFrame([("",)], "r string")
    assert {r.row: r.d for r in distances.min_edit_distance(df, "row", "s", none, "r", "d").collect()} == {1: 4, 2: 0}


# file digests

def test_digests_of_large_and_small_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    contents = {"a.txt": b"", "deep/b.bin": bytes(range(256)) * 5000, "c d.txt": b"x" * 10}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".hidden").write_bytes(b"no")
    with open(tmp_path / "large.bin", "wb") as f:  # sparse: three gigabytes that take no room
        f.truncate(3 << 30)
    zeros, total = hashlib.sha256(), bytes(1 << 24)
    for _ in range(3 << 6):
        zeros.update(total)
    got = {r.path.removeprefix(f"file:{tmp_path}/"): (r.size, r.sha256) for r in tables.inventory(spark, str(tmp_path)).collect()}
    want = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}
    assert got == want | {"large.bin": (3 << 30, zeros.hexdigest())}
    one = digests.file_digests(spark, f"file://{tmp_path}/deep", piece=7).collect()
    assert [r.sha256 for r in one] == [want["deep/b.bin"][1]]


def test_digests_of_many_files_are_dealt_by_size(tmp_path):
    for k in range(30):
        (tmp_path / f"{k}").write_bytes(b"z" * k)
    parts = digests.DigestReader(str(tmp_path), 4).partitions()
    assert sum(len(p.files) for p in parts) == 30
    with pytest.raises(FileNotFoundError):
        digests.DigestReader(str(tmp_path / "none"), 4).partitions()


# weighted draws

@pytest.mark.parametrize("per_task", [None, 7])
def test_alias_cells_hold_every_weight_exactly(spark, per_task):
    rng = random.Random(5)
    for weights in ([3], [1, 1, 1], [0, 5, 0, 1], [rng.choice([0, 1, 2, 30, 500]) + 1 for _ in range(60)], [1000, *[1] * 40]):
        df = spark.createDataFrame([(f"s{k:03}", float(w)) for k, w in enumerate(weights)], "source string, w double")
        cells = cp.alias_table(df, "source", "w", per_task).collect()
        held = collections.Counter()
        for c in cells:
            assert -1e-9 <= c.stays <= 1 + 1e-9 and (c.alias is not None or c.stays > 1 - 1e-9)
            held[c.name] += c.stays
            held[c.alias] += 1 - c.stays
        assert sorted(c.cell for c in cells) == list(range(len(weights)))
        for k, w in enumerate(weights):
            assert math.isclose(held[f"s{k:03}"] / len(weights), w / sum(weights), abs_tol=1e-9)


def test_draws_follow_the_weights_of_many_sources(spark):
    df = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("source"), (F.col("id") % 5).cast("double").alias("w"))
    drawn = cp.source_draws(df, "source", "w", 50_000, 7)
    shares = {r.k: r.n / 50_000 for r in drawn.groupBy((F.substring("source", 2, 9).cast("long") % 5).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert 0 not in shares and all(abs(shares[k] - k / 10) < 0.02 for k in (1, 2, 3, 4))
    with pytest.raises(ValueError):
        cp.source_draws(df.withColumn("w", F.lit(-1.0)), "source", "w", 3, 7)


# label conflicts in event time

def brute_conflicts(rows, keep):
    out, first = set(), {}
    for at, row, key, label in sorted(rows):
        if key not in first or at > first[key][0] + keep:
            first[key] = (at, label)
        else:
            out.add((key, row, label, label != first[key][1]))
    return out


def test_label_conflicts_do_not_depend_on_arrival(spark, tmp_path):
    rng = random.Random(6)
    rows = [(1000 + rng.randrange(200), k, rng.choice("abc"), rng.choice(["0", "1", None])) for k in range(90)]
    want = brute_conflicts(rows, 60)
    assert any(c for *_, c in want) and any(not c for *_, c in want)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "at long, row_id long, sequence_hash string, target string"
    try:
        for trial, files in enumerate((1, 4)):
            rng.shuffle(rows)
            folder, out, ck = (str(tmp_path / f"{n}{trial}") for n in ("in", "out", "ck"))
            for part in range(files):
                spark.createDataFrame(rows[part::files], schema).coalesce(1).write.mode("append").parquet(folder)

            def run():
                arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_seconds("at"))
                stream.label_conflicts(arriving, "ts", "10 minutes", 60_000).writeStream.format("parquet").option("path", out).option(
                    "checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

            run()
            spark.createDataFrame([(10_000, -1, "end", None)], schema).write.mode("append").parquet(folder)
            run()
            got = spark.read.schema("sequence_hash string, row_id long, target string, conflict boolean").parquet(out).collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# registered policies that declare their blocking

def plain_components(rows, like):
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a == b or like(a, b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("kind", ["metric", "keys"])
def test_declared_policies_are_searched_without_a_row_limit(spark, kind):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ACGT") for _ in range(rng.randrange(8, 60)))) for k in range(300)] + [(300 + k, "ACGTACGT") for k in range(40)]
    share = lambda s: s.str.count("[GC]") / s.str.len()
    gc = lambda s: sum(c in "GC" for c in s) / len(s)
    if kind == "metric":
        fn, like, extra = lambda a, b: 1 - (share(a) - share(b)).abs(), lambda a, b: 1 - abs(gc(a) - gc(b)) >= 0.999 - 1e-9, {"metric": True}
    else:
        fn = lambda a, b: (a.str[:3] == b.str[:3]).astype(float) * (1 - (share(a) - share(b)).abs())
        like = lambda a, b: a[:3] == b[:3] and 1 - abs(gc(a) - gc(b)) >= 0.999 - 1e-9
        extra = {"keys": lambda s, t: F.array(F.substring(s, 1, 3))}
    sim.register_similarity_policy("declared_likeness", fn, replace=True, **extra)
    try:
        df = spark.createDataFrame(rows, "id long, payload string")
        tally = []
        edges = sim.declared_edges(df, "declared_likeness", 0.999, tally=tally)
        got = {r.id: r.component for r in connected_components(df.select("id"), edges).collect()}
        assert got == plain_components(rows, like)
        assert sum(a for a, _ in tally) < 0.2 * 300 * 299 / 2
        same = sim.leakage_components(df, "id", "payload", policy="declared_likeness", threshold=0.999)
        assert {r.id: r.component for r in same.collect()} == got
    finally:
        sim.unregister_similarity_policy("declared_likeness")
