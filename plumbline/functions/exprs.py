"""Column expressions on probabilities; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def clipped(p: Column) -> Column:
    """p moved into [1e-12, 1 - 1e-12]."""
    return F.greatest(F.least(p.cast("double"), F.lit(1 - EPS)), F.lit(EPS))


def logit(p: Column) -> Column:
    p = clipped(p)
    return F.log(p) - F.log1p(-p)


def expit(z: Column) -> Column:
    """The logistic function, without overflow at either end."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """How many of the (sorted, few) edges are at most x: right-closed lookup."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x))


def pick(index: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)


def wilson(rate: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a rate over n trials, kept in [0, 1] and around the rate."""
    centre = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.least(F.greatest(centre - half, F.lit(0.0)), rate)
    return low, F.greatest(F.least(centre + half, F.lit(1.0)), rate)


def traffic_light(p: Column) -> Column:
    return F.when(p <= 0.01, "red").when(p <= 0.05, "amber").otherwise("green")
