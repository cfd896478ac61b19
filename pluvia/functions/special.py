"""Distribution functions Spark has no built-in for, as Arrow-batched column functions.

They run on result rows (one per series, feature or rank), never on raw data.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return p.map(lambda x: inv(x) if 0.0 < x < 1.0 else math.nan)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|T| >= |t|) = I_{dof/(dof+t^2)}(dof/2, 1/2)."""
    return pd.Series([
        math.nan if pd.isna(a) or pd.isna(d) or d <= 0
        else _beta_ratio(d / 2.0, 0.5, d / (d + a * a))
        for a, d in zip(t, dof)
    ], index=t.index, dtype="float64")


@F.pandas_udf(DoubleType())
def gamma_shape(gap: pd.Series) -> pd.Series:
    """Maximum-likelihood shape from log(mean) - mean(log), location 0."""
    return gap.map(_solve_shape)


@F.pandas_udf(DoubleType())
def gamma_quantile(p: pd.Series, shape: pd.Series) -> pd.Series:
    """Standard gamma quantile by bisection on the regularised integral."""
    return pd.Series(_gamma_ppf(p.to_numpy(float), shape.to_numpy(float)), index=p.index)


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_ratio(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    value, num, den = 1.0, 1.0, 0.0
    for i in range(300):
        j = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = j * (b - j) * x / ((a + 2 * j - 1) * (a + 2 * j))
        else:
            term = -(a + j) * (a + b + j) * x / ((a + 2 * j) * (a + 2 * j + 1))
        den = 1.0 / _off_zero(1.0 + term * den)
        num = _off_zero(1.0 + term / num)
        value *= num * den
        if abs(1.0 - num * den) < 1e-14:
            break
    return front * (value - 1.0)


def _off_zero(x: float) -> float:
    return x if abs(x) > 1e-300 else 1e-300


def _digamma(x: float) -> float:
    shift = 0.0
    while x < 8.0:
        shift -= 1.0 / x
        x += 1.0
    y = 1.0 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def _solve_shape(gap: float) -> float:
    if not gap or math.isnan(gap) or gap <= 0:
        return math.nan
    a = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        h = 1e-5 * a
        f = math.log(a) - _digamma(a) - gap
        slope = 1 / a - (_digamma(a + h) - _digamma(a - h)) / (2 * h)
        step = f / slope
        a = a - step if a > step else a / 2
        if abs(step) < 1e-12 * a:
            break
    return a


def _gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma by its power series."""
    term = 1.0 / a
    total = term.copy()
    for n in range(1, 600):
        term = term * x / (a + n)
        total += term
        if np.all(term < 1e-15 * total):
            break
    lg = np.array([math.lgamma(v) for v in a])
    with np.errstate(divide="ignore"):
        return np.where(x > 0, total * np.exp(a * np.log(np.maximum(x, 1e-300)) - x - lg), 0.0)


def _gamma_ppf(p: np.ndarray, a: np.ndarray) -> np.ndarray:
    lo = np.zeros_like(p)
    hi = a + 12.0 * np.sqrt(a) + 40.0
    for _ in range(70):
        mid = 0.5 * (lo + hi)
        below = _gamma_cdf(a, mid) < p
        lo = np.where(below, mid, lo)
        hi = np.where(below, hi, mid)
    return 0.5 * (lo + hi)
