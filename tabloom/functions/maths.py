"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6378.0


def ln_or_null(c: Column) -> Column:
    """Natural log; null for values that are not positive."""
    return F.when(c > 0, F.ln(c))


def log1p_rounded(c: Column, digits: int = 1) -> Column:
    """log(1 + x) rounded, 0 for nulls and for x <= -1."""
    return F.coalesce(F.round(F.when(c > -1, F.log1p(c)), digits), F.lit(0.0))


def reciprocal(c: Column, shift: float = 0.0) -> Column:
    return F.try_divide(F.lit(1.0), c + F.lit(float(shift)))


def square_root(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def power(c: Column, exponent: float) -> Column:
    return F.pow(c.cast("double"), F.lit(float(exponent)))


def box_cox(c: Column, lam: float) -> Column:
    x = F.when(c > 0, c.cast("double"))
    return F.ln(x) if lam == 0 else (F.pow(x, F.lit(float(lam))) - 1.0) / F.lit(float(lam))


def exponential(c: Column) -> Column:
    return F.exp(c)


def abs_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def displacement(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    inner = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # `least` would pass over a null
    return F.asin(F.when(inner > 1, F.lit(1.0)).otherwise(F.sqrt(inner))) * F.lit(2 * EARTH_RADIUS_KM)


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


# Coefficients of Acklam's rational approximation of the inverse
# normal distribution function (relative error below 1.2e-9).
INV_NORMAL_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
INV_NORMAL_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
INV_NORMAL_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INV_NORMAL_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
INV_NORMAL_TAIL = 0.02425


def _horner(x: Column, coefs: tuple[float, ...], end: float | None = None) -> Column:
    out = F.lit(coefs[0])
    for k in coefs[1:] if end is None else (*coefs[1:], end):
        out = out * x + F.lit(k)
    return out


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile as a column expression."""

    def tail(q: Column) -> Column:
        r = F.sqrt(F.lit(-2.0) * F.ln(q))
        return _horner(r, INV_NORMAL_C) / _horner(r, INV_NORMAL_D, 1.0)

    mid = p - F.lit(0.5)
    r = mid * mid
    centre = mid * _horner(r, INV_NORMAL_A) / _horner(r, INV_NORMAL_B, 1.0)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < INV_NORMAL_TAIL, tail(p))
        .when(p > 1 - INV_NORMAL_TAIL, -tail(F.lit(1.0) - p))
        .otherwise(centre)
    )
