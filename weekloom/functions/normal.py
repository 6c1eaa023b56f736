"""The normal distribution and polynomials as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of the distribution's tail (Hart 1968, as given by West 2005), highest power first,
# and of its inverse (Acklam 2003), highest power first.
_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_MID_UP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MID_DOWN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_UP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_DOWN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """By Horner's rule, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out


def upper_tail(z: Column) -> Column:
    """Probability that a normal variable exceeds ``z``."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    near = e * polynomial(a, _UP) / polynomial(a, _DOWN)
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + F.lit(float(k)) / far
    p = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(e / far / 2.506628274631)
    return F.when(z > 0, p).otherwise(1 - p)


def quantile(p: Column) -> Column:
    """The value that a normal variable stays below with probability ``p``; null outside of 0 to 1. Relative error
    of about 1e-9."""
    q = p - 0.5
    middle = q * polynomial(q * q, _MID_UP) / polynomial(q * q, _MID_DOWN)
    tail = lambda x: (lambda t: polynomial(t, _TAIL_UP) / polynomial(t, _TAIL_DOWN))(F.sqrt(-2 * F.log(x)))
    return F.when((p <= 0) | (p >= 1), None).when(p < _TAIL, tail(p)).when(p > 1 - _TAIL, -tail(1 - p)).otherwise(middle)
