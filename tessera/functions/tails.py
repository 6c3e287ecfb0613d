"""Tail probabilities of test statistics, for single values of a report."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, dof: float) -> float:
    """P(X >= x): the regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, x = dof / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a)) if x < 700 + a else math.exp(max(-745.0, a * math.log(x) - x - math.lgamma(a)))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def wilcoxon_p(n: float, w_plus: float, w_minus: float, tie_sum: float, alternative: str = "two-sided", n_zero: float = 0) -> float | None:
    """p of the signed-rank test by the normal approximation, corrected for ties.

    ``n`` counts the ranked pairs; ``n_zero`` the zero differences that were ranked and dropped.
    """
    if not n:
        return None
    mean = n * (n + 1) / 4 - n_zero * (n_zero + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - n_zero * (n_zero + 1) * (2 * n_zero + 1) / 24 - tie_sum / 48
    if var <= 0:
        return None
    if alternative == "greater":
        return normal_sf((w_plus - mean) / math.sqrt(var))
    if alternative == "less":
        return normal_sf(-(w_plus - mean) / math.sqrt(var))
    return min(1.0, 2 * normal_sf(abs(min(w_plus, w_minus) - mean) / math.sqrt(var)))
