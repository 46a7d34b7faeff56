"""Upper tails of the t, F and chi-squared distributions.

Used on a handful of test statistics per table. Continued fractions and series of
the incomplete beta and gamma functions, evaluated with the Lentz method.
"""

from __future__ import annotations

import math

_TINY, _EPS, _STEPS = 1e-300, 1e-15, 10_000


def _lentz(terms) -> float:
    """Continued fraction b0 + a1/(b1 + a2/(b2 + ...)) from pairs (a, b)."""
    first = next(terms)[1]
    value = c = first or _TINY
    d = 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return value


def _beta_fraction(x: float, a: float, b: float):
    yield 0.0, 1.0
    for i in range(1, _STEPS):
        m = i // 2
        if i % 2:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        else:
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(1.0 - x, b, a)
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(scale + a * math.log(x) + b * math.log1p(-x)) / a
    return min(1.0, front / _lentz(_beta_fraction(x, a, b)))


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_tail(df / (df + t * t), df / 2.0, 0.5)


def f_tail(f: float, df1: float, df2: float) -> float:
    if math.isinf(f):
        return 0.0
    return beta_tail(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def chi2_tail(x: float, df: float) -> float:
    a, x = df / 2.0, x / 2.0
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    terms = ((-i * (i - a) if i else 0.0, x + 2 * i + 1.0 - a) for i in range(_STEPS))
    return front / _lentz(terms)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation over ``n`` pairs."""
    if n <= 2 or abs(r) >= 1.0:
        return 0.0 if n > 2 else 1.0
    return t_two_sided(r * math.sqrt((n - 2) / ((1.0 - r) * (1.0 + r))), n - 2)


def kolmogorov_tail(d: float, n: int) -> float:
    """P that the largest gap of n draws from the compared distribution is at least d (asymptotic)."""
    root = math.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * (j * x) ** 2) for j in range(1, 101))))
