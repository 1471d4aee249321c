"""Ratios with the reference's division semantics.

pandas gives ``x/0 = inf`` and ``0/0 = NaN``; Spark with ANSI on raises. These
helpers reproduce ``inf`` explicitly and return null where pandas has NaN, so a
later comparison is false as in pandas (Spark treats NaN as larger than any
number). ANSI mode stays on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col

INF = float("inf")


def safe_ratio(num, den) -> Column:
    """``num/den``; ``+-inf`` for a zero denominator, null for 0/0."""
    num, den = as_col(num), as_col(den)
    return (F.when(den != 0, num.cast("double") / den)
            .when(num > 0, F.lit(INF))
            .when(num < 0, F.lit(-INF)))


def pct_increase(base, test) -> Column:
    """H7: ``(test - base) / base * 100``; ``inf`` when base is 0 and test > 0."""
    base, test = as_col(base), as_col(test)
    return safe_ratio(test - base, base) * 100.0


def per_flow(total, flows) -> Column:
    """H8 / H9: a sum or count divided by a flow count (always >= 1)."""
    return as_col(total).cast("double") / as_col(flows)


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def round6(c) -> Column:
    """Averages and ratios are compared with the oracle at 6 decimals."""
    return F.round(as_col(c), 6)
