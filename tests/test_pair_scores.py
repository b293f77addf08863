"""Scores of pairs whose tokens are derived from the sequences beside them."""

import random

from pyspark.sql import functions as F

from seqaudit.functions import seq
from seqaudit.operators import similarity as sim


def test_tokens_are_derived_once_and_scores_are_the_same(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("ACGTN", [6, 6, 6, 6, 1], k=rng.randrange(40)))
    rows = [(word(), word()) for _ in range(80)] + [(w, w) for w in ("", "AC", "ACGTACGT", "NNNN")] + [(None, "ACGTA"), ("ACGTA", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    for tokens in (seq.kmers, seq.positional_kmers):
        x, y = tokens("a", 4), tokens("b", 4)
        got = df.select(sim.jaccard_once(x, y).alias("once"), sim.jaccard(x, y).alias("plain")).collect()
        assert [r.once for r in got] == [r.plain for r in got]
    plan = df.select(sim.pair_similarity("a", "b", "canonical_kmer_jaccard", 4).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=([ACGT]{4}))") == 4  # two strands of two sequences


def test_edit_scores_come_from_batches(spark):
    rows = [("ACGT", "AGT"), ("", ""), ("", "A"), (None, "A"), ("é😀", "e😀x")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("e", sim.pair_similarity("a", "b", "edit_distance"))
    assert [r.e for r in df.collect()] == [r.e for r in df.withColumn("e", sim.edit_similarity(F.col("a"), F.col("b"))).collect()]
    assert "levenshtein(" not in df._jdf.queryExecution().optimizedPlan().toString()
