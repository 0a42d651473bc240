"""Table counts of Pitman-Yor restaurants, drawn from their exact conditional; shared by all levels of the hierarchy.

A restaurant with discount d and strength s that seats c customers of a dish at t tables has the weight
S(c, t) p^t for the dish, with S the generalised Stirling numbers and p the parent's probability, and the factor
(s|d)_T = d^T Gamma(s/d + T) / Gamma(s/d) for all its T tables. The Gamma function is an integral over a variable g;
given g ~ Gamma(s/d + T) the dishes of a restaurant are independent, each with weight S(c, t) (d g p)^t. So a Gibbs sweep
draws g for each restaurant and then every dish's tables at once, and no customer is seated approximately.
"""

from __future__ import annotations

import numpy as np

#: Counts up to this many customers have their Stirling numbers in a table; more are drawn by Metropolis steps on ``log_stirling``.
TABLE = 1024
_BERNOULLI = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after shifting small arguments."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    out = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi)
    power = 1 / x
    for b in _BERNOULLI:
        out += b * power
        power = power / (x * x)
    return out - shift


def stirling_table(discount: float, size: int = TABLE) -> np.ndarray:
    """log S(c, t) for 1 <= t <= c <= size, by S(c+1, t) = S(c, t-1) + (c - d t) S(c, t); row and column 0 are unused."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[1, 1] = 0.0
    places = np.arange(1, size + 1)
    for c in range(1, size):
        t = places[:c]
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, 0 : c + 1])
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) by the saddle point of c! / (t! d^t) [z^c] (1 - (1-z)^d)^t; good where t is not small against c^d."""
    low, high = np.full(c.shape, -80.0), np.full(c.shape, -1e-12)  # of log u, u = 1 - z; the slope falls from infinity to t
    for _ in range(64):
        mid = 0.5 * (low + high)
        above = np.log(t * d) + (d - 1) * mid + np.log(-np.expm1(mid)) - np.log(-np.expm1(d * mid)) > np.log(c)
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    lu = 0.5 * (low + high)
    u, z, v = np.exp(lu), -np.expm1(lu), -np.expm1(d * lu)
    first = d * np.exp((d - 1) * lu) * z / v
    second = first * (1 + (1 - d) * z / u - first)
    return log_gamma(c + 1) - log_gamma(t + 1) - t * np.log(d) + t * np.log(v) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(t * second, 1e-300))


def log_stirling(customers: np.ndarray, tables: np.ndarray, discount: float, terms: int = 400) -> np.ndarray:
    """log S(c, t) for many customers (c beyond ``TABLE``), to two per cent of S, or ten where all customers but a few sit alone.

    Up to some multiple of c^d tables by the exact sum 1 / (t! d^t) sum_j (-1)^j C(t, j) Gamma(c - jd) / Gamma(-jd),
    where its terms cancel too little to matter; beyond by the saddle point.
    """
    c, t, d = (np.atleast_1d(np.asarray(x, float)) for x in (customers, tables, discount))
    d = float(d[0])
    out = np.empty(np.broadcast(c, t).shape)
    c, t = np.broadcast_to(c, out.shape), np.broadcast_to(t, out.shape)
    near = (1 - d) * (t * np.exp(-d * np.log(c))) ** (1 / (1 - d)) <= 14
    out[~near] = _saddle(c[~near], t[~near], d)
    for lo in range(0, int(near.sum()), 4096):
        some = np.flatnonzero(near)[lo : lo + 4096]
        cs, ts = c[some][:, None], t[some][:, None]
        j = np.arange(1.0, min(terms, int(ts.max())) + 1)[None, :]
        inside = (j <= ts) & (j * d < cs - 8)
        size = log_gamma(ts + 1) - log_gamma(j + 1) - log_gamma(np.where(inside, ts - j, 0.0) + 1)
        size = size + log_gamma(np.where(inside, cs - j * d, 1.0)) + log_gamma(1 + j * d)
        sine = np.sin(np.pi * (j * d)) / np.pi  # 1 / Gamma(-x) = -Gamma(1 + x) sin(pi x) / pi
        size = np.where(inside, size + np.log(np.maximum(np.abs(sine), 1e-300)), -np.inf)
        top = size.max(axis=1, keepdims=True)
        part = np.exp(size - top) * np.where(j % 2 == 1, 1.0, -1.0) * np.sign(sine)
        total = part.sum(axis=1)
        good = (total > 1e-9) & (np.abs(part[:, -1]) <= 1e-9 * np.maximum(total, 1e-300)) | (ts[:, 0] <= terms) & (total > 1e-9)
        value = np.log(np.maximum(total, 1e-300)) + top[:, 0] - log_gamma(ts[:, 0] + 1) - ts[:, 0] * np.log(d)
        out[some] = np.where(good, value, _saddle(cs[:, 0], ts[:, 0], d))
    return out


class Seating:
    """Draws of table counts for one discount."""

    def __init__(self, discount: float):
        self.discount = float(discount)
        self.table = stirling_table(self.discount)

    def first(self, customers: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A start for ``draw``: about as many tables as the weight makes likely."""
        c = np.maximum(customers, 1)
        guess = np.minimum(weight * np.log1p(c / np.maximum(weight, 1e-12)) / max(self.discount, 0.05), c**self.discount + weight)
        return np.clip(np.rint(guess), 1, c).astype(np.int64)

    def draw(self, rng: np.random.Generator, customers: np.ndarray, weight: np.ndarray, tables: np.ndarray, steps: int = 8) -> np.ndarray:
        """t with probability in proportion to S(c, t) weight^t for each dish (0 for no customer).

        Up to ``TABLE`` customers the draw is exact and independent of ``tables``; beyond, ``steps`` symmetric Metropolis
        steps from ``tables``.
        """
        out = np.minimum(customers, 1).astype(np.int64)
        some = np.flatnonzero(customers > 1)
        c, y = customers[some], np.log(np.maximum(weight[some], 1e-300))
        order = np.argsort(c, kind="stable")
        c, y, some = c[order], y[order], some[order]
        border = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True]) if len(c) else np.zeros(1, np.int64)
        for lo, hi in zip(border[:-1], border[1:]):
            n = int(c[lo])
            if n > TABLE:
                break
            logs, t = self.table[n, 1 : n + 1], np.arange(1, n + 1)
            step = max(1, (1 << 20) // n)
            for a in range(lo, hi, step):
                b = min(hi, a + step)
                chance = logs[None, :] + y[a:b, None] * t[None, :]
                chance = np.exp(chance - chance.max(axis=1, keepdims=True))
                np.cumsum(chance, axis=1, out=chance)
                out[some[a:b]] = 1 + (chance < rng.random(b - a)[:, None] * chance[:, -1:]).sum(axis=1).clip(max=n - 1)
        many = np.searchsorted(c, TABLE, "right")
        if many < len(c):
            c, y, some = c[many:], y[many:], some[many:]
            t = np.clip(tables[some], 1, c).astype(np.int64)
            reach = 1 + np.sqrt(self.first(c, np.exp(y))).astype(np.int64)
            now = log_stirling(c, t, self.discount) + t * y
            for _ in range(steps):
                to = t + np.where(rng.random(len(t)) < 0.5, -1, 1) * (1 + (rng.random(len(t)) * reach).astype(np.int64))
                inside = (to >= 1) & (to < c)
                to = np.where(inside, to, t)
                then = log_stirling(c, to, self.discount) + to * y
                take = inside & (np.log(rng.random(len(t)) + 1e-300) < then - now)
                t, now = np.where(take, to, t), np.where(take, then, now)
            out[some] = t
        return out


def spread(rng: np.random.Generator, opened: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """The variable g of each restaurant, given its open tables."""
    return rng.gamma(strength / discount + opened)


def discount_of(once: int, twice: int) -> float:
    """A discount from how many counts are one and two."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.95))
