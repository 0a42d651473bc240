"""Special functions of statistics in numpy and the standard library."""

from __future__ import annotations

import math
from collections.abc import Sequence


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 600):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return out


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log) * _fraction(a, b, x) / a
    return 1 - math.exp(log) * _fraction(b, a, 1 - x) / b


def gammainc(s: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b, c = x + 1 - s, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - scale * h


def _bisect(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, df: float) -> float:
    return 1 - gammainc(df / 2, x / 2)


def chi2_ppf(q: float, df: float) -> float:
    top = 1.0
    while gammainc(df / 2, top / 2) < q:
        top *= 2
    return _bisect(lambda v: gammainc(df / 2, v / 2) - q, 0.0, top)


def beta_ppf(q: float, a: float, b: float) -> float:
    return _bisect(lambda v: betainc(a, b, v) - q, 0.0, 1.0)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(q: float) -> float:
    if not 0 < q < 1:
        raise ValueError("q must lie strictly between 0 and 1")
    return _bisect(lambda v: norm_cdf(v) - q, -40.0, 40.0)


def erf_vec(x: Sequence[float]) -> list[float]:
    """The error function of each number."""
    return [math.erf(v) for v in x]
