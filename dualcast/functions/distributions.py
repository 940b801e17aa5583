"""Tail probabilities for one already aggregated row per test."""

from __future__ import annotations

import math

import numpy as np


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for an integer number of degrees of freedom (finite sums)."""
    half = x / 2.0
    if df % 2 == 0:
        terms = [half**k / math.factorial(k) for k in range(df // 2)]
        return math.exp(-half) * sum(terms)
    total = math.erfc(math.sqrt(half))
    for k in range((df - 1) // 2):
        total += math.exp(-half) * half ** (k + 0.5) / math.gamma(k + 1.5)
    return total


def signed_rank_cdf(n: int, w: float) -> float:
    """Exact P(W+ <= w) without ties; a fractional statistic is rounded up."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for rank in range(1, n + 1):
        counts[rank:] = counts[rank:] + counts[:-rank].copy()
    upto = min(int(math.ceil(w)), len(counts) - 1)
    return float(counts[: upto + 1].sum() / 2.0**n)


def signed_rank_p(n: int, w_plus: float, w_minus: float, ties: float, zeros: int, alternative: str, method: str) -> float:
    """p-value of the signed-rank test; ``auto`` is exact up to 50 pairs without ties or zeros."""
    if n == 0:
        return 1.0
    exact = method == "exact" or (method == "auto" and n <= 50 and ties == 0 and zeros == 0)
    if exact:
        if alternative == "less":
            return signed_rank_cdf(n, w_plus)
        return min(1.0, 2.0 * signed_rank_cdf(n, min(w_plus, w_minus)))
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2.0) / 24.0)
    z = (w_plus - n * (n + 1) / 4.0) / spread
    return normal_tail(-z) if alternative == "less" else min(1.0, 2.0 * normal_tail(abs(z)))
