"""Distribution functions that neither Spark nor the standard library has."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by the continued fraction of Lentz."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if beta_cdf(middle, a, b) < p:
            low = middle
        else:
            high = middle
        if high - low < 1e-15:
            break
    return (low + high) / 2


def gamma_cdf(x: float, a: float) -> float:
    """The regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = total = 1 / b
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * total


def chi2_cdf(x: float, degrees: float) -> float:
    return gamma_cdf(x / 2, degrees / 2)


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact binomial interval of a share k / n."""
    tail = (1 - confidence) / 2
    low = 0.0 if k == 0 else beta_quantile(tail, k, n - k + 1)
    high = 1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k)
    return low, high


def clopper_pearson_columns(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """STRUCT<low, high> by an Arrow function; for results, not for ions."""

    @F.pandas_udf("low double, high double")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), confidence) for a, b in zip(ks, ns)], columns=["low", "high"])

    return interval(k, n)
