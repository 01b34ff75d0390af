"""Student's t distribution for whole degrees of freedom.

With theta = atan(t / sqrt(df)) the probability of |T| <= t is a finite sum in
sin(theta) and cos(theta) (two closed forms, for even and for odd degrees). The
p-value is that sum as a column expression; only quantiles, which need a
search, run in an Arrow-batched pandas UDF, on one-row results of aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|); null without a statistic or a degree of freedom."""
    df = df.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    sin, cos = F.sin(theta), F.cos(theta)
    even = df % 2 == 0
    odd = F.when(even, 0).otherwise(1)
    # each term is the one before it times cos^2 and (2k - 1)/(2k), or 2k/(2k + 1)
    steps = F.when(df >= 4, F.sequence(F.lit(1), F.floor((df - 2) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    terms = F.aggregate(
        F.when(df == 3, F.array().cast("array<int>")).otherwise(steps),
        F.struct(F.when(even, F.lit(1.0)).otherwise(cos).alias("term"), F.when(even, F.lit(1.0)).otherwise(cos).alias("sum")),
        lambda a, k: F.struct((a["term"] * cos * cos * (2 * k - 1 + odd) / (2 * k + odd)).alias("term"),
                              (a["sum"] + a["term"] * cos * cos * (2 * k - 1 + odd) / (2 * k + odd)).alias("sum")))["sum"]
    within = F.when(even, sin * terms).when(df == 1, 2 * theta / math.pi).otherwise(2 / math.pi * (theta + sin * terms))
    return F.when((df >= 1) & ~F.isnan(t), 1 - within)


def t_within(t: float, df: int) -> float:
    """P(|T| <= |t|)."""
    theta = math.atan(abs(t) / math.sqrt(df))
    sin, cos = math.sin(theta), math.cos(theta)
    if df == 1:
        return 2 * theta / math.pi
    odd = df % 2
    term = total = cos if odd else 1.0
    for k in range(1, (df - 2) // 2 + 1):
        term *= cos * cos * (2 * k - 1 + odd) / (2 * k + odd)
        total += term
    return 2 / math.pi * (theta + sin * total) if odd else sin * total


def t_cdf(t: float, df: float) -> float:
    half = t_within(t, int(df)) / 2
    return 0.5 + half if t > 0 else 0.5 - half


def t_ppf(q: float, df: float) -> float:
    """Quantile of the t distribution by bisection on the CDF."""
    if not 0.0 < q < 1.0:
        return math.nan
    if q == 0.5:
        return 0.0
    if q < 0.5:
        return -t_ppf(1.0 - q, df)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < q:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < q:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15 * max(1.0, hi):
            break
    return 0.5 * (lo + hi)


def _nan_safe(f, *xs):
    if any(x is None or (isinstance(x, float) and math.isnan(x)) for x in xs):
        return None
    return f(*xs)


@F.pandas_udf(DoubleType())
def t_quantile_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_nan_safe(t_ppf, a, b) for a, b in zip(q, df)], dtype="float64")
