"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0 to about twelve digits: a power series below 2, a continued fraction from there."""
    z = z.cast("double")
    zero = F.struct(F.lit(0.0).alias("total"), z.alias("term"))
    series = F.aggregate(F.sequence(F.lit(0), F.lit(59)), zero, lambda a, n: F.struct((a["total"] + a["term"]).alias("total"), (a["term"] * 2 * z * z / (2 * n + 3)).alias("term")), lambda a: a["total"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), z, lambda f, k: z + k / (2 * f))
    scale = F.exp(-z * z)
    return F.when(z < 2, 1 - scale * series * (2 / math.sqrt(math.pi))).otherwise(scale / fraction / math.sqrt(math.pi))


def normal_two_sided(z: Column) -> Column:
    """Probability that a standard normal is at least as far from 0 as z."""
    return erfc(F.abs(z) / math.sqrt(2))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, from its 200th term back."""
    def back(f: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / f)

    f = F.aggregate(F.sequence(F.lit(200), F.lit(1)), F.lit(1.0), back)
    return 1 / (1 - (a + b) * x / (a + 1) / f)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability that Student's t with ``df`` > 0 degrees of freedom is at least as far from 0 as ``t``; null for other ``df``.

    It is the regularised incomplete beta function of (df / 2, 1 / 2) at
    df / (df + t^2), by whichever of its two fractions converges fast. The gamma
    functions in front of it come from Stirling's series.
    """
    df = df.cast("double")
    x = df / (df + t * t)
    a, b = df / 2, F.lit(0.5)
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - math.lgamma(0.5) + a * F.log(x) + b * F.log1p(-x))
    left = front * _beta_fraction(a, b, x) / a
    right = 1 - front * _beta_fraction(b, a, 1 - x) / b
    p = F.when(x >= 1, F.lit(1.0)).when(x <= 0, F.lit(0.0)).when(x < (a + 1) / (a + b + 2), left).otherwise(right)
    return F.when(df > 0, p)


def _log_gamma(z: Column) -> Column:
    """log gamma of z > 0: Stirling's series at z + 12, less the logarithms of the twelve factors between."""
    y = z + 12
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    factors = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0.0), lambda s, k: s + F.log(z + k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - factors
