"""Tails of the Poisson and binomial distributions, as pandas functions over Arrow batches."""

from __future__ import annotations

from itertools import count
from math import exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tail(first: float, ratio) -> float:
    """log of a sum of terms exp(first) * prod(ratio(i)), until they no longer count."""
    total = term = 1.0
    i = 0
    while term > 1e-17 * total and i < 10_000_000:
        term *= ratio(i)
        total += term
        i += 1
    return first + log(total)


def poisson_upper(k: int, mean: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    if k <= mean:
        return max(0.0, 1.0 - poisson_lower(k - 1, mean))
    return min(1.0, exp(_tail(k * log(mean) - mean - lgamma(k + 1.0), lambda i: mean / (k + 1 + i))))


def poisson_lower(k: int, mean: float) -> float:
    """P(X <= k); 1 for a mean of 0."""
    if k < 0:
        return 0.0
    if mean <= 0:
        return 1.0
    if k > mean + 2 * sqrt(mean):
        return max(0.0, 1.0 - exp(_tail((k + 1) * log(mean) - mean - lgamma(k + 2.0), lambda i: mean / (k + 2 + i))))
    return min(1.0, exp(_tail(k * log(mean) - mean - lgamma(k + 1.0), lambda i: (k - i) / mean if i < k else 0.0)))


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of positive a and b and 0 < x < 1, element by element, by its continued fraction."""
    turned = x > (a + 1) / (a + b + 2)  # there the fraction of the complement is the one that converges fast
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    log_gamma = np.frompyfunc(lgamma, 1, 1)
    front = np.exp((log_gamma(a + b) - log_gamma(a) - log_gamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x)) / a
    upper, lower = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    value = lower
    for m in count(1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            lower, upper = 1 / (1 + step * lower), 1 + step / upper
            value = value * lower * upper
        if not np.any(np.abs(lower * upper - 1) > 1e-14):
            break
    return np.where(turned, 1 - front * value, front * value)


def binomial_upper(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) of n trials, over arrays."""
    k, n, p = np.broadcast_arrays(*(np.asarray(x, float) for x in (k, n, p)))
    out = np.where((k <= 0) | ((p >= 1) & (k <= n)), 1.0, 0.0)
    inner = (k > 0) & (k <= n) & (p > 0) & (p < 1)
    if inner.any():
        out[inner] = np.clip(beta_share(k[inner], n[inner] - k[inner] + 1, p[inner]), 0.0, 1.0)
    return out


def poisson_upper_p(k: Column, mean: Column) -> Column:
    @F.pandas_udf("double")
    def tail(k: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([poisson_upper(int(a), float(b)) for a, b in zip(k, mean, strict=True)])

    return tail(k, mean)


def poisson_lower_p(k: Column, mean: Column) -> Column:
    @F.pandas_udf("double")
    def tail(k: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([poisson_lower(int(a), float(b)) for a, b in zip(k, mean, strict=True)])

    return tail(k, mean)


def binomial_upper_p(k: Column, n: Column, p: Column) -> Column:
    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(binomial_upper(k, n, p))

    return tail(k, n, p)
