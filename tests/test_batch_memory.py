"""Feature functions leave nothing of a batch behind that only a garbage collection would free."""

import gc

import numpy as np
import pandas as pd

from seqaudit.operators import models as ml


def test_length_features_hold_no_batch():
    build = ml.gc_length_matrix("sequence")
    series = lambda: sum(isinstance(o, pd.Series) for o in gc.get_objects())
    gc.collect()
    gc.disable()
    try:
        before = series()
        for _ in range(5):
            build(pd.DataFrame({"sequence": ["ACGTN", "GGCC"]}))
        assert series() == before
    finally:
        gc.enable()


def test_length_features_of_odd_rows():
    x = ml.gc_length_matrix("sequence")(pd.DataFrame({"sequence": ["ACGTN", "", None, "gc"]}, dtype=object))
    np.testing.assert_allclose(x, [[np.log1p(5), 0.4], [0, 0], [np.nan, np.nan], [np.log1p(2), 0]])
    assert ml.gc_length_matrix("sequence")(pd.DataFrame({"sequence": []}, dtype=object)).shape == (0, 2)
