"""Small statistics on finished one-row or per-group results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a rational approximation of erfc (absolute error below 1.2e-7).
_ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def two_sided_p_sql(z: str) -> str:
    """The same expression as SQL text."""
    x = f"(abs({z}) / sqrt(2::DOUBLE))"
    t = f"(1 / (1 + 0.5::DOUBLE * {x}))"
    poly = f"{_ERFC[-1]}::DOUBLE"
    for c in reversed(_ERFC[:-1]):
        poly = f"({poly} * {t} + ({c})::DOUBLE)"
    return f"{t} * exp(-{x} * {x} + {poly})"


def _beta_tail(t: float, df: float) -> float:
    """Two-sided Student t tail by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return math.nan
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 500):
            for top in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + top * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + top / (c if abs(c) > tiny else tiny)
                out *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(x, a, b) / a
    return 1.0 - front * fraction(1.0 - x, b, a) / b


def student_p_sql(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided p-value of Student's t as SQL text, by Simpson's rule over the density from 0 to |t|."""
    x = f"(abs({t}) * i / {steps}::DOUBLE)"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(1 + {x} * {x} / {df}, -({df} + 1) / 2::DOUBLE)))"
    scale = f"exp(lgamma(({df} + 1) / 2::DOUBLE) - lgamma({df} / 2::DOUBLE)) / sqrt({df} * pi())"
    return f"(1 - 2 * {scale} * {area} * abs({t}) / {3 * steps}::DOUBLE)"


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, for the few rows of a finished read-out."""

    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(np.array([_beta_tail(a, b) for a, b in zip(t, df)], dtype="float64"))

    return F.pandas_udf(tail, "double")(t, df)
