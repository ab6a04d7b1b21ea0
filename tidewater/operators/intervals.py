"""Joins of points and ranges without a row for each key of a range.

A range [lo, hi) lies in cells of the least power of two that is not under its width, so it touches two cells at most;
a point lies in one cell of each width that some range has. So the join is one on (width, cell), whatever the ranges'
widths, and every hit is then held against the range's ends. Cells of one width spread points as evenly as the ranges
do; a cell with too many points is cut by the skew handling of the join, as neither side has to stay whole.

Bounds are integers (days, months, keys); empty ranges and null bounds meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(width: Column) -> Column:
    """Exponent of the least power of two that is not under the width."""
    return F.when(width <= 1, 0).otherwise(F.length(F.bin(width - 1))).cast("int")


def _cell(x: Column, at: Column) -> Column:
    return F.call_function("shiftright", x, at)


def point_join(points: DataFrame, ranges: DataFrame, at: str, lo: str = "lo", hi: str = "hi", by: tuple = ()) -> DataFrame:
    """Each point beside each range of its `by` with lo <= at < hi; columns of both, those of `by` once.

    The two tables' other columns have to differ in name.
    """
    low, high = F.col(lo).cast("long"), F.col(hi).cast("long")
    whole = ranges.where(F.col(lo) < F.col(hi)).withColumn("__level", level(high - low))
    cut = whole.withColumn("__cell", F.explode(F.sequence(_cell(low, F.col("__level")), _cell(high - 1, F.col("__level")))))
    widths = whole.agg(F.collect_set("__level").alias("__widths"))  # one row of 64 numbers at most
    spread = points.where(F.col(at).isNotNull()).join(F.broadcast(widths), F.lit(True)).withColumn("__level", F.explode("__widths")).drop("__widths")
    spread = spread.withColumn("__cell", _cell(F.col(at).cast("long"), F.col("__level")))
    hits = spread.join(cut, [*by, "__level", "__cell"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)))
    return hits.drop("__level", "__cell")


def overlap_join(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], by: tuple = ()) -> DataFrame:
    """Each two ranges of a and b that share a point: one begins inside the other, so two joins of points hold them all once."""
    (a_lo, a_hi), (b_lo, b_hi) = a_ends, b_ends
    a, b = a.where(F.col(a_lo) < F.col(a_hi)), b.where(F.col(b_lo) < F.col(b_hi))
    begins = point_join(a, b, a_lo, b_lo, b_hi, by)
    behind = a.withColumn("__after", F.col(a_lo) + 1)
    inside = point_join(b, behind, b_lo, "__after", a_hi, by).drop("__after")
    return begins.unionByName(inside)


def missed(points: DataFrame, ranges: DataFrame, at: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Distinct values of `at` that no range holds."""
    values = points.select(at).where(F.col(at).isNotNull()).distinct()
    return values.join(point_join(values, ranges.select(lo, hi), at, lo, hi).select(at).distinct(), at, "left_anti")
