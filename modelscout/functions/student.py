"""Upper tail of Student's t distribution (scalar, used on per-group summaries only)."""
from __future__ import annotations

import math

import numpy as np

STEP = 1.0 / 16.0
_X = np.arange(-6.0, 4.5, STEP)
NODES = np.exp(_X - np.exp(-_X))
NODE_WEIGHTS = STEP * NODES * (1.0 + np.exp(-_X))


def _log_gamma_ratio(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)): the recurrence up to 20, from there the asymptotic series, whose rest is below 1e-15."""
    shift = 0.0
    while a < 20.0:
        shift += math.log(a / (a + 0.5))
        a += 1.0
    series = -1 / 8 + (1 / 192 + (-1 / 640 + (17 / 14336 - 31 / 18432 / a**2) / a**2) / a**2) / a**2
    return shift + 0.5 * math.log(a) + series / a


def _fall(v: np.ndarray, df: float) -> np.ndarray:
    """df * log(cosh(v / sqrt(df))) for v >= 0."""
    z = v / math.sqrt(df)
    return df * np.where(z < 20.0, 0.5 * np.log1p(np.sinh(np.minimum(z, 20.0)) ** 2), z - math.log(2.0))


def t_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0, in one way for all degrees of freedom.

    With s = sqrt(df) sinh(v / sqrt(df)) the density's integral becomes that of cosh(v / sqrt(df)) ** -df, which falls off
    exponentially; it is taken by the double-exponential rule, with a fixed number of nodes.
    """
    if math.isinf(t):
        return 0.0
    root = math.sqrt(df)
    start = root * math.asinh(t / root)
    first = float(_fall(np.array(start), df))
    scale = 1.0 / (1.0 + root * math.tanh(start / root))
    rest = float(np.sum(NODE_WEIGHTS * np.exp(first - _fall(start + scale * NODES, df)))) * scale
    return math.exp(_log_gamma_ratio(df / 2.0) - first) * rest / math.sqrt(df * math.pi)


def grubbs_rejects(g: float, n: int, alpha: float) -> bool:
    """Whether the two-sided Grubbs statistic ``g`` of ``n`` values reaches its critical value at level ``alpha``.

    The critical value tau solves tail(t(tau)) = alpha/(2n) with t(g) = g*sqrt(n(n-2)/((n-1)^2 - n g^2)); t grows
    with g, so comparing tail probabilities decides the same without inverting the distribution.
    """
    room = (n - 1.0) ** 2 - n * g * g
    t = math.inf if room <= 0 else g * math.sqrt(n * (n - 2.0) / room)
    return t_tail(t, n - 2.0) <= alpha / (2.0 * n)
