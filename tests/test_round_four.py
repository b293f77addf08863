"""Loops whose rounds and size estimates must not grow with the data."""

import random

from seqaudit.operators import components as comp
from seqaudit.session import cut, settle


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(comp, "settle", lambda df: written.append(1) or settle(df))
    chain = spark.createDataFrame([(i, i + 1) for i in range(600)], "src long, dst long")
    found = comp.contract(chain).collect()
    assert {tuple(r) for r in found} == {(i, 0) for i in range(601)}
    assert len(written) <= 20  # four places a round would be 150 rounds of two tables


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((30, 18), (60, 60), (40, 200)):
        edges = [(rng.randrange(n) * 7 % n, rng.randrange(n)) for _ in range(m)]
        low = list(range(n))
        for _ in range(n):
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        got = comp.connected_components(spark.range(n), spark.createDataFrame(edges, "src long, dst long"))
        assert {r["id"]: r["component"] for r in got.collect()} == dict(enumerate(low))


def test_settled_tables_are_taken_at_their_own_size(spark):
    rows = spark.range(50).selectExpr("id", "id % 7 as v")
    kept, grown = settle(rows), cut(rows)
    for _ in range(4):
        kept = settle(kept.join(kept.withColumnRenamed("v", "w"), "id").select("id", "v"))
        grown = cut(grown.join(grown.withColumnRenamed("v", "w"), "id").select("id", "v"))
    size = lambda df: float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
    assert size(kept) < 1e6 < size(grown)


def test_metrics_derive_their_rows_once(spark):
    from pyspark.sql import functions as F

    from seqaudit.operators import ingest, metrics as m

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    made = spark.range(40).selectExpr("id", "cast((id * 7) % 11 as double) as t", "cast((id * 5) % 13 as double) as p", "id / 40.0D as u", "id % 2 as g")
    rows = made.mapInPandas(counted, made.schema)
    jobs = [lambda: m.pairwise_accuracy(rows, "t", "p"), lambda: m.uncertainty_audit(rows, "t", "p", "u", "id")[0],
            lambda: m.uncertainty_audit(rows, "t", "p", "u", "id")[1], lambda: m.ranking_audit(rows, "t", "p", "id", 5),
            lambda: m.spearman(rows, "t", "p"), lambda: ingest.target_summary(rows, "t", ["g"])]
    for job in jobs:
        before = read.value
        assert job().collect()
        assert read.value - before == 40
    med = {r["g"]: r["median"] for r in ingest.target_summary(rows, "t", ["g"]).collect()}
    assert med == {r["g"]: r["m"] for r in made.groupBy("g").agg(F.percentile("t", 0.5).alias("m")).collect()}


def test_ensemble_is_fitted_on_the_rows_that_have_label_and_vector(spark):
    from seqaudit.operators import models as ml

    full = [(i, [float(i % 5), float(i % 3)], float(i % 7)) for i in range(40)]
    holes = [(100, None, 1.0), (101, [1.0, 2.0], None), (102, None, None)]
    fit = lambda rows: ml.fit_ensemble(spark.createDataFrame(rows, "id long, x array<double>, y double"), ["x"],
                                       ml.array_features("x"), "y", "id", members=3, first_plain=True)
    for a, b in zip(fit(full), fit(full + holes), strict=True):
        assert abs(a - b).max() < 1e-9


def test_a_similarity_search_keeps_less_than_its_sets(spark):
    import os

    from seqaudit.functions import seq
    from seqaudit.operators import similarity as sim
    from seqaudit.session import ensure_checkpoint_dir

    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(200))) for i in range(2000)]
    rows += [(2000 + i, s) for i, s in rows[:5]]
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = size()
    table = sim.SetTable(spark.createDataFrame(rows, "id long, payload string"), lambda c: seq.kmers(c, 8), 0.9)
    assert size() - before < 1500 * len(rows)  # the 193 hashes of a row alone are 1,544 bytes
    assert {tuple(r) for r in table.stars.collect()} == {(i, 2000 + i) for i in range(5)}
    assert table.reps.count() == 2000
