"""Ensembles of any width, logistic members, single trees, and diversity under registered policies."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from seqaudit.operators import candidates as c, models as ml, similarity as sim
from seqaudit.session import cut


@pytest.mark.parametrize("head_bytes", [ml.HEAD_BYTES, 20_000])
def test_thousands_of_heads_in_blocks(spark, head_bytes):
    rng = np.random.default_rng(1)
    x, w, bias = rng.normal(size=(40, 6)), rng.normal(size=(5000, 6)), rng.normal(size=5000)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(40, None)], "row long, x array<double>")
    heads = spark.createDataFrame([(k, float(b), r.tolist()) for k, (b, r) in enumerate(zip(bias, w))], "member int, bias double, weights array<double>")
    for logistic in (False, True):
        z = x @ w.T + bias
        z = 1 / (1 + np.exp(-z)) if logistic else z
        got = {r.row: (r.prediction, r.uncertainty) for r in ml.score_embeddings(df, "x", heads, logistic, head_bytes).collect()}
        assert got.pop(40) == (None, None)
        for k, (mean, std) in got.items():
            assert math.isclose(mean, z[k].mean(), abs_tol=1e-9) and math.isclose(std, z[k].std(ddof=1), abs_tol=1e-9)


def test_one_head_has_no_spread(spark):
    df = spark.createDataFrame([(1, [2.0])], "row long, x array<double>")
    heads = spark.createDataFrame([(0, 0.5, [3.0])], "member int, bias double, weights array<double>")
    assert [(r.prediction, r.uncertainty) for r in ml.score_embeddings(df, "x", heads).collect()] == [(6.5, 0.0)]


def plain_logistic(x, y, w, penalty=1.0):
    z = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [penalty] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    return beta


def test_logistic_members_minimise_their_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.5, -1, 0, 0.5] + rng.normal(size=300) > 1).astype(float)
    df = cut(spark.createDataFrame([(k, r.tolist(), float(t)) for k, (r, t) in enumerate(zip(x, y))], "row long, x array<double>, y double"))
    weights = ml.stratified_weights(df, "y", 3, 13, "row", True).orderBy("row").collect()
    w = np.array([r["__w"] for r in weights])
    assert (w[:, 0] == 1).all()
    for m in range(3):  # each class keeps its number of rows
        assert math.isclose(w[y == 1, m].sum(), y.sum(), rel_tol=1e-9) and math.isclose(w[y == 0, m].sum(), (1 - y).sum(), rel_tol=1e-9)
    heads = ml.fit_logistic_ensemble(df, ["x"], ml.array_features("x"), "y", "row", 4, members=3, first_plain=True)
    for m, head in enumerate(heads):
        assert np.allclose(head, plain_logistic(x, y, w[:, m]), atol=1e-5)
    assert not np.allclose(heads[1], heads[2], atol=1e-3)


def test_separable_classes_and_one_class(spark):
    rows = [(k, [float(k)], float(k >= 10)) for k in range(20)]
    df = cut(spark.createDataFrame(rows, "row long, x array<double>, y double"))
    head = ml.fit_logistic_ensemble(df, ["x"], ml.array_features("x"), "y", "row", 1, members=1, first_plain=True)[0]
    assert np.allclose(head, plain_logistic(np.arange(20.0)[:, None], np.arange(20) >= 10, np.ones(20)), atol=1e-4)
    one = ml.fit_logistic_ensemble(df.where("y = 1"), ["x"], ml.array_features("x"), "y", "row", 1, members=1, first_plain=True)[0]
    assert np.isfinite(one).all() and 1 / (1 + math.exp(-(one[0] + 15 * one[1]))) > 0.95


def walk(nodes, x):
    at = nodes[0]
    while at.feature >= 0:
        at = nodes[at.lower if x[at.feature] <= at.threshold else at.upper]
    return at.prediction


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_single_trees_agree_with_the_forest(spark, tmp_path, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    df = cut(spark.createDataFrame([(k, r.tolist(), float(r[0] * 2 + (r[1] > 0) + 0.1 * rng.normal())) for k, r in enumerate(x)],
                                   "row long, x array<double>, y double"))
    model = RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=7, maxDepth=4, seed=3, predictionCol="p").fit(
        df.withColumn("f", array_to_vector("x")))
    nodes = cut(ml.forest_nodes(model, str(tmp_path / "forest"), spark))
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n.tree, {})[n.node] = n
    want = {r.row: r.p for r in model.transform(df.withColumn("f", array_to_vector("x"))).collect()}
    for r in ml.tree_spread(df, nodes, "x", block).collect():
        single = np.array([walk(t, x[r.row]) for t in trees.values()])
        assert math.isclose(r.tree_mean, single.mean(), abs_tol=1e-9) and math.isclose(r.tree_std, single.std(), abs_tol=1e-7)
        assert math.isclose(r.tree_mean, want[r.row], abs_tol=1e-9)


def test_diverse_ranking_under_a_registered_policy(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(5, 20))), rnd.random() / 5) for i in range(50)]
    rows += [(50 + i, rows[i][1], 0.0) for i in range(10)]
    near = lambda a, b: 1 - (a.str.len() - b.str.len()).abs() / 20
    sim.register_similarity_policy("length_likeness", near, replace=True)
    try:
        df = spark.createDataFrame([(1, *r) for r in rows], "pool long, id long, s string, a double")
        picks = cut(c.greedy_diverse(df, "pool", "id", "s", "a", method="length_likeness", top_k=6, shortlist=8))
        like = lambda a, b: 1 - abs(len(a) - len(b)) / 20
        chosen = []
        for _ in range(6):
            score = lambda r: r[2] - 0.2 * max([like(r[1], p[1]) for p in chosen], default=0.0)
            chosen.append(max((r for r in rows if r not in chosen), key=lambda r: (score(r), -r[0])))
        assert [r.id for r in picks.orderBy("rank").collect()] == [r[0] for r in chosen]
        rounds = c.greedy_rounds(df.select("pool", "id", "s", F.col("a").alias("score")), c.diversity_kind("length_likeness"), 0.2, 3, 3)
        assert [r.id for r in rounds.orderBy("rank").collect()] == [r[0] for r in chosen[:3]]
        got = {r.id: r.diversity_cluster for r in c.diversity_clusters(df, picks, "pool", "id", "s", "length_likeness").collect()}
        for r in rows:
            own = [k for k, p in enumerate(chosen, 1) if p[0] == r[0]] or [k for k, p in enumerate(chosen, 1) if like(r[1], p[1]) >= 0.95] or [-1]
            assert got[r[0]] == own[0]
    finally:
        sim.unregister_similarity_policy("length_likeness")
    with pytest.raises(ValueError):
        c.diversity_kind("customer_family_labels")


def test_clusters_of_copies(spark):
    rows = [(1, 1, "ACGTACGTAC", 0.9), (1, 2, "ACGTACGTAC", 0.8), (1, 3, "GGGGGGGGGG", 0.7), (1, 4, "TTTTTAAAAA", 0.1), (2, 5, "ACGTACGTAC", 0.1)]
    df = spark.createDataFrame(rows, "pool long, id long, s string, a double")
    picks = c.greedy_diverse(df, "pool", "id", "s", "a", penalty=1.0, top_k=2)
    got = {r.id: r.diversity_cluster for r in c.diversity_clusters(df, picks, "pool", "id", "s").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: -1, 5: 1}


@pytest.mark.parametrize("shortlist", [3, 40, 500])
def test_several_farthest_picks_a_round(spark, shortlist):
    rnd = random.Random(6)
    rows = [(p, "".join(rnd.choice("ACGT") for _ in range(rnd.choice([14, 14, 14, 9]))), "A" * 14) for p in range(3) for _ in range((300, 60, 4)[p])]
    far = lambda a, b: sum(x != y for x, y in zip(a, b)) / len(a) if len(a) == len(b) else 1.0
    want = {}
    for p in range(3):
        pool, picks = sorted({s for q, s, _ in rows if q == p}), []
        picks = sorted(pool, reverse=True) if len(pool) <= 20 else []
        while len(picks) < min(20, len(pool)):
            picks.append(max((s for s in pool if s not in picks), key=lambda s: (min([far(s, x) for x in picks], default=np.inf), far(s, "A" * 14), s)))
        want |= {(p, i + 1): s for i, s in enumerate(picks)}
    rounds = []
    got = c.farthest_first(spark.createDataFrame(rows, "p long, s string, base string"), "p", "s", "base", 20, shortlist, rounds).collect()
    assert {(r.pool, r.pick): r.sequence for r in got} == want
    assert sum(rounds) == 40 and (shortlist < 40 or len(rounds) <= 12)
