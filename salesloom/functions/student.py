"""Two-sided p-value of a correlation coefficient.

Spark has no incomplete beta function: the integral behind it is a weighted sum over a few fixed places, so a group costs
microseconds, on rows that are aggregates already (one per group).  ``incomplete_beta`` is the same for arrays in numpy, by
its continued fraction.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    c = np.ones_like(x)
    h = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / guard(1.0 + step * d)
            c = guard(1.0 + step / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def _log_gamma(v: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x) for x in v])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function for arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(
            _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)
            + p * np.log(y) + q * np.log1p(-y)
        ) / p
    out = np.where(y <= 0.0, 0.0, front * _beta_fraction(p, q, np.clip(y, 0.0, 1.0)))
    return np.where(swap, 1.0 - out, out)


# Fixed nodes and weights: a smooth integral on [0, 1], and one against exp(-q) from 0 on (weights that add nothing left out).
_NEAR = [((x + 1) / 2, w / 2) for x, w in zip(*map(np.ndarray.tolist, np.polynomial.legendre.leggauss(16)))]
_FAR = [(x, w) for x, w in zip(*map(np.ndarray.tolist, np.polynomial.laguerre.laggauss(32))) if w > 1e-18]
#: ``-a log(1 - r^2)`` up to which the middle of the distribution is integrated, beyond it the tail.
_MIDDLE = 2.0


def _weighted(nodes: list[tuple[float, float]], f) -> Column:
    """Sum of ``w * f(x)`` over the nodes."""
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in nodes])
    return F.aggregate(pairs, F.lit(0.0), lambda s, n: s + n["w"] * f(n["x"]))


def _log_ratio(a: Column) -> Column:
    """Logarithm of gamma(a + 1/2) / gamma(a), by its series ten places further up."""
    z = a + 10
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, F.lit(3))) - 1 / (640 * F.pow(z, F.lit(5))) + 17 / (14336 * F.pow(z, F.lit(7)))
    return reduce(lambda s, i: s + F.log((a + i) / (a + i + 0.5)), range(10), series)


def corr_p_value(r: Column, n: Column) -> Column:
    """p-value of ``r`` over ``n`` points under Student's t with ``n - 2`` degrees of freedom; null below three points.

    With a = (n - 2) / 2 it is the integral of cos(f)^(2a - 1) beyond asin(|r|), or, with l = log(1 - r^2), that of
    exp(-q) / sqrt(1 - exp(l - q / a)), both up to a factor.  The first is smooth in the middle, the second in the tail.
    """
    size = F.least(F.abs(r), F.lit(1.0))
    a = (F.greatest(n.cast("double"), F.lit(3.0)) - 2) / 2

    def value(v: Column) -> Column:
        a, l, angle = v["a"], v["l"], v["angle"]
        sine = lambda x: F.sin(angle * x)
        middle = 1 - 2 * v["c"] * angle * _weighted(_NEAR, lambda x: F.exp((a - 0.5) * F.log1p(-sine(x) * sine(x))))
        tail = v["c"] * F.exp(a * l) / a * _weighted(_FAR, lambda q: F.lit(1.0) / F.sqrt(-F.expm1(l - q / a)))
        return F.when(-a * l <= _MIDDLE, middle).otherwise(tail)

    # worked out once per row, not once per node
    once = F.struct(a.alias("a"), F.log1p(-size * size).alias("l"), F.asin(size).alias("angle"),
                    F.exp(_log_ratio(a) - math.log(math.pi) / 2).alias("c"))
    p = F.transform(F.array(once), value)[0]
    return F.when(r.isNotNull() & (n > 2), F.when(size >= 1, F.lit(0.0)).otherwise(p))
