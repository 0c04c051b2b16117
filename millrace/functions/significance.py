"""Tail probabilities of test statistics. Scalars only: one value per reported pair of columns."""
from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf(x: float, dof: float) -> float:
    """Upper regularised incomplete gamma Q(dof/2, x/2), by series or continued fraction."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, t = dof / 2.0, x / 2.0
    front = math.exp(-t + a * math.log(t) - math.lgamma(a))
    if t < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= t / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = t + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation through Student's t with n - 2 degrees of freedom."""
    if n < 3 or r != r:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    t2 = r * r * dof / (1 - r * r)
    return beta_cdf(dof / (dof + t2), dof / 2.0, 0.5)


def dagostino_k2(n: int, g1: float, g2: float) -> tuple[float, float]:
    """D'Agostino-Pearson omnibus K2 and p from the population skewness g1 and excess kurtosis g2."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    zs = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2)) if y else 0.0
    mean_b2 = 3.0 * (n - 1) / (n + 1)
    var_b2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (g2 + 3 - mean_b2) / math.sqrt(var_b2)
    root_b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / root_b1 * (2 / root_b1 + math.sqrt(1 + 4 / root_b1 ** 2))
    base = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    zk = (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    k2 = zs * zs + zk * zk
    return k2, math.exp(-k2 / 2)
