"""AUROC of bootstrap replicates: all replicates in one pass over the sorted scores."""

import random

from pyspark.sql import functions as F

from seqaudit.functions.hashrand import poisson, uniform
from seqaudit.operators import bootstrap as bs, metrics as m


def table(spark):
    rng = random.Random(9)
    rows = [(f"u{rng.randrange(40)}", rng.choice([0, 1, 1, None]), rng.choice([0.5, 0.5, 0.5, rng.random(), None, -3.0, 9.0])) for _ in range(600)]
    rows += [(None, 1, 0.25), (None, 0, 0.5), ("ü", 1, 0.5)]
    return spark.createDataFrame(rows, "unit string, label int, score double")


def test_counts_are_those_of_the_weights(spark):
    units = table(spark).select("unit").distinct()
    got = {r.unit: list(r.draws) for r in bs.drawn_counts(units, 30, 42).collect()}
    drawn = units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("w", poisson(uniform(F.lit(42), "rep", "unit")))
    want = {}
    for r in drawn.orderBy("rep").collect():
        want.setdefault(r.unit, []).append(int(r.w))
    assert got == want


def test_replicates_equal_the_metric_of_the_drawn_rows(spark, monkeypatch):
    monkeypatch.setattr(bs, "SLICE", 7)
    rows, reps = table(spark), 25
    clipped = rows.withColumn("score", F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("score"))))
    drawn = clipped.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", poisson(uniform(F.lit(3), "rep", "unit"))).where("w > 0")
    want = {r.rep: r.auroc for r in m.auroc(drawn, "label", "score", ["rep"], F.col("w")).collect()}
    got = {r.rep: r.v for r in bs.replicate_metrics(rows, reps, 3, "classification", "label", {"v": "score"}).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    one = rows.where("label = 1")
    assert {r.v for r in bs.replicate_metrics(one, 5, 3, "classification", "label", {"v": "score"}).collect()} == {None}
    assert bs.replicate_metrics(rows.limit(0), 5, 3, "classification", "label", {"v": "score"}).collect() == []


def test_rows_are_not_multiplied_by_the_replicates(spark):
    plan = bs.replicate_metrics(table(spark), 50, 3, "classification", "label", {"v": "score"})._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan and "explode([" not in plan
