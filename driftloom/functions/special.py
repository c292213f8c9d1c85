"""Distribution tails: normal, chi-squared, F and t, by incomplete gamma and beta functions."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection."""
    a, b = -40.0, 40.0
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if normal_cdf(m) < p else (a, m)
    return (a + b) / 2


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    return scale * fraction(lambda n: -n * (n - a), lambda n: x + 2 * n + 1 - a)


def fraction(top, bottom) -> float:
    """1 / (b0 + a1 / (b1 + a2 / (b2 + ...))) by Lentz's method."""
    tiny = 1e-300
    f = bottom(0) or tiny
    c, d = f, 0.0
    for n in range(1, 10_000):
        a, b = top(n), bottom(n)
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 / f


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    scale = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a

    def top(n: int) -> float:
        m = n // 2
        if n % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return scale * fraction(top, lambda n: 1.0)


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def f_sf(x: float, df1: float, df2: float) -> float:
    return beta_lower(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if x > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_lower(df / 2, 0.5, df / (df + t * t))
