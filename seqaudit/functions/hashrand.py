"""Deterministic pseudo-random columns.

Every draw is a function of a seed and row keys, so a retried task, a different
partitioning or a re-planned stage gives the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .values import col


def digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[(col(p) if not isinstance(p, (int, float)) else F.lit(p)).cast("string")
                                    for p in parts]))


def draw_int(*parts) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    return draw_int(*parts) / F.lit(4294967296.0)


def pick(size, *parts) -> Column:
    """Uniform index in [0, size)."""
    return draw_int(*parts) % col(size) if not isinstance(size, int) else draw_int(*parts) % F.lit(size)


def poisson_steps() -> list[float]:
    """P(X <= 0), P(X <= 1), … of a Poisson(1) count, up to eight."""
    return [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8)]


def poisson(u: Column) -> Column:
    """Poisson(1) count (at most eight) of a uniform number: a bootstrap weight."""
    return sum((F.when(u > c, 1.0).otherwise(0.0) for c in poisson_steps()), F.lit(0.0))
