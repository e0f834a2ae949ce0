"""Numeric helpers shared by operators (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(c, digits: int = 6) -> Column:
    """Round half up to ``digits`` decimals with plain IEEE steps.

    ``floor(x * 10^d + 0.5) / 10^d`` gives the same double on any engine,
    unlike ``round`` (decimal half-up in Spark, binary in others).
    """
    scale = float(10 ** digits)
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def as_percent(c) -> Column:
    """Ratio -> percent with two decimals (``floor(x*1e4+0.5)/100``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(1e4) + F.lit(0.5)) / F.lit(100.0)


def safe_div(num, den) -> Column:
    """num / den, 0.0 when the denominator is 0 (undefined metric -> 0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def erfc(x) -> Column:
    """Complementary error function for x >= 0.

    Abramowitz & Stegun 7.1.26 (|error| <= 1.5e-7); written with basic
    arithmetic so SQL engines without ``erf`` compute the same value.
    """
    x = F.col(x) if isinstance(x, str) else x
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (
        F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return poly * F.exp(-(x * x))
