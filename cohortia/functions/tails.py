"""Upper tails of the F and chi-square laws, for the few rows of a test table."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300
CLOSE = 1e-15


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > CLOSE * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - scale * total
    return scale * _fraction(
        x + 1 - a, lambda k: (-k * (k - a), x + 2 * k + 1 - a), first=1.0
    )


def lower_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - lower_beta(b, a, 1 - x)
    log_scale = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    def step(k: int) -> tuple[float, float]:
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return math.exp(log_scale) / a * _fraction(1.0, step, first=1.0)


def _fraction(start: float, step, first: float) -> float:
    """first / (start + a1 / (b1 + a2 / (b2 + ...))), evaluated from the front; step(k) = (a_k, b_k)."""
    value = c = start
    d, ratio, k = 0.0, 0.0, 0
    while abs(ratio - 1.0) > CLOSE and k < 10_000:
        k += 1
        num, den = step(k)
        d = den + num * d
        d = 1.0 / (d if d else TINY)
        c = den + num / c
        c = c if c else TINY
        ratio = c * d
        value *= ratio
    return first / value


@F.pandas_udf(T.DoubleType())
def chi_square_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(s) or pd.isna(k) or k <= 0 else upper_gamma(k / 2, s / 2)
            for s, k in zip(statistic, df, strict=True)
        ],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def f_tail(ratio: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(r) or df_a <= 0 or df_b <= 0 else lower_beta(df_b / 2, df_a / 2, df_b / (df_b + df_a * r))
            for r, df_a, df_b in zip(ratio, df1, df2, strict=True)
        ],
        dtype="float64",
    )
