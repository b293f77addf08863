"""Steps that the model queries share."""

import random

import numpy as np
import pandas as pd

from seqaudit.functions import seq
from seqaudit.plans import model_queries as mq

SF = "/root/testdata/sf0.001"


def test_frequencies_of_a_batch(monkeypatch):
    rng = random.Random(3)
    texts = ["", "A", "AC", "ACGT", "NNNN", "ACNGT", "AC😀GT"] + ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.randrange(60))) for _ in range(50)]
    for letters in (30, 500_000):
        monkeypatch.setattr(seq, "LETTERS", letters, raising=False)
        for k in (1, 3, 4):
            want = np.zeros((len(texts), 4 ** k))
            for row, t in zip(want, texts):
                held = [t[i:i + k] for i in range(len(t) - k + 1) if set(t[i:i + k]) <= set("ACGT")]
                for w in held:
                    row[seq.vocabulary(k).index(w)] += 1
                row /= max(1, len(held))
            assert np.array_equal(seq.kmer_matrix(pd.Series(texts), k), want)
    assert seq.kmer_matrix(pd.Series([], dtype=object), 3).shape == (0, 64)


def test_sides_are_derived_once(spark):
    for side in mq._sides(spark, SF):
        assert "regexp_extract_all" not in side._jdf.queryExecution().optimizedPlan().toString() and side.count() > 0
