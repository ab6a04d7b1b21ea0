"""Scalar expressions: keyed uniforms, half-even rounding, clamps, guarded ratios, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this, totals, sizes and means count as zero.
EPS = 1e-12


#: Hexadecimal digits of a draw: 52 bits, all of which a double holds.
DIGITS = 13


def bits(a: Column, b: Column) -> Column:
    """52 random bits for a pair of integers (a key and a counter): the head of the MD5 of "a:b", which any engine can repeat."""
    digest = F.md5(F.concat(a.cast("string"), F.lit(":"), b.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def uniform(a: Column, b: Column) -> Column:
    """A repeatable value in [0, 1) for a pair of integers; values of different pairs are independent draws."""
    return bits(a, b) / F.lit(float(16**DIGITS))


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def clamp(x: Column, low=None, high=None) -> Column:
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or the other value where b is nothing."""
    return F.when(b > EPS, a / b).otherwise(F.lit(otherwise))


def shown(x: Column) -> Column:
    """Six decimals; numbers under 1e-4 other than zero in scientific notation."""
    small = (x != 0) & (F.abs(x) < 1e-4)
    return F.when(small, F.format_string("%.6e", x)).otherwise(F.format_string("%.6f", x))
