"""Upper tails of the normal, t, F and chi-square distributions for the handful
of test statistics a report holds (driver-side scalars, not data rows)."""

from __future__ import annotations

import math


def _continued_fraction(step, tiny: float = 1e-300, eps: float = 1e-15, rounds: int = 10_000) -> float:
    """Modified Lentz evaluation; step(i) yields the i-th (a, b) pair."""
    _, b0 = step(0)
    f = b0 or tiny
    c, d = f, 0.0
    for i in range(1, rounds):
        a, b = step(i)
        d = 1.0 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1.0) < eps:
            break
    return f


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(1.0 - x, b, a)

    def step(i: int) -> tuple[float, float]:
        if i == 0:
            return 0.0, 1.0
        m, odd = divmod(i - 1, 2)
        if odd:
            m += 1
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return front / (a * _continued_fraction(step))


def gamma_upper_share(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = acc = 1.0 / a
        k = a
        while abs(term) > abs(acc) * 1e-16:
            k += 1
            term *= x / k
            acc += term
        return 1.0 - front * acc
    return front / _continued_fraction(lambda i: (-i * (i - a), x + 2 * i + 1 - a) if i else (0.0, x + 1 - a))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return beta_share(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper_share(df / 2.0, x / 2.0)


def t_critical(share_two_sided: float, df: float) -> float:
    """t value whose two-sided tail is the given share (bisection)."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > share_two_sided else (lo, mid)
    return (lo + hi) / 2


# MacKinnon's (1994) response surface of the Dickey-Fuller t with a constant, one variable: least and
# largest statistic, the point between its two polynomials, and their coefficients.
UNIT_ROOT_RANGE = (-18.83, 2.74)
UNIT_ROOT_BREAK = -1.61
UNIT_ROOT_LOW = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(t: float) -> float:
    """Approximate p-value of a Dickey-Fuller statistic (regression with a constant)."""
    if t <= UNIT_ROOT_RANGE[0]:
        return 0.0
    if t >= UNIT_ROOT_RANGE[1]:
        return 1.0
    surface = UNIT_ROOT_LOW if t <= UNIT_ROOT_BREAK else UNIT_ROOT_HIGH
    z = sum(c * t**i for i, c in enumerate(surface))
    return 0.5 * math.erfc(-z / math.sqrt(2))
