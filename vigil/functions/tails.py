"""Exact tail probabilities, for one value of each entity; numpy on Arrow batches, as SQL has no gamma function."""

from __future__ import annotations

from math import exp, inf, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction from the side on which that is short."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            part = 1.0
        elif i % 2 == 0:
            part = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            part = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + part * d if abs(1 + part * d) > tiny else tiny)
        c = 1 + part / c if abs(1 + part / c) > tiny else tiny
        value *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (value - 1.0)


def binomial_upper(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_share(k, n - k + 1, p)


def negative_binomial_lower(k: int, mean: float, size: float) -> float:
    """P(X <= k) for a mean and a size (variance mean + mean^2 / size); an infinite size is a Poisson law."""
    if mean <= 0:
        return 1.0
    if size == inf:
        terms = np.arange(k + 1)
        return float(min(1.0, np.exp(-mean + terms * log(mean) - np.array([lgamma(t + 1) for t in terms])).sum()))
    return beta_share(size, k + 1, size / (size + mean))


def beta_binomial_lower(k: int, n: int, a: float, b: float) -> float:
    """P(X <= k) of n draws whose chance has a beta law; summed from the shorter side, 1e5 terms at a time."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    if k > n / 2:
        return 1.0 - beta_binomial_lower(n - k - 1, n, b, a)
    whole, total = lgamma(a + b) - lgamma(a) - lgamma(b) + lgamma(n + 1) - lgamma(n + a + b), 0.0
    for low in range(0, k + 1, 100_000):
        total += sum(
            exp(whole + lgamma(i + a) - lgamma(i + 1) + lgamma(n - i + b) - lgamma(n - i + 1)) for i in range(low, min(low + 100_000, k + 1))
        )
    return min(1.0, total)


def _each(f):
    """f over rows of columns; null where any is null."""

    def column(*names: str) -> Column:
        @F.pandas_udf("double")
        def values(*parts: pd.Series) -> pd.Series:
            return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*parts)], dtype="float64")

        return values(*(F.col(n) for n in names))

    return column


binomial_upper_of = _each(lambda k, n, p: binomial_upper(int(k), int(n), float(p)))
negative_binomial_lower_of = _each(lambda k, mean, size: negative_binomial_lower(int(k), float(mean), float(size)))
beta_binomial_lower_of = _each(lambda k, n, a, b: beta_binomial_lower(int(k), int(n), float(a), float(b)))
