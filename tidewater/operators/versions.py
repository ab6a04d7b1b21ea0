"""Layouts over time: a log of changes with undo as a row, intervals of validity, and work routed by the layout of its time.

All versions of a layout are one table of slices (version, slice_id, lo, hi, size, server); the log says when which one
was put in place. Nothing is kept on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .intervals import point_join
from .ordered import asof, scanned


def validity(log: DataFrame) -> DataFrame:
    """since, version, until (null: still valid) of each change, from a log of (since, version); a row without a version undoes the last change that stands.

    Raises where an undo has nothing to go back to. `since` is a number, and no two rows share one.
    """
    step = F.when(F.col("version").isNull(), -1).otherwise(1).cast("long")
    depth = written(scanned(log.select("since", "version"), ["since"], {"depth": step}))
    if found := depth.where("depth < 1").limit(1).collect():
        raise ValueError(f"nothing to go back to at {found[0]['since']}")
    # at one depth of the stack the last version put there is the one that an undo comes back to
    there = Window.partitionBy("depth").orderBy("since").rowsBetween(Window.unboundedPreceding, 0)
    stands = written(depth.select("since", F.last("version", ignorenulls=True).over(there).alias("version")))
    return asof(stands, stands.select(F.col("since").alias("until")).withColumn("__next", F.col("until")), "since", "__next", ["until"], following=True, strict=True)


def version_at(work: DataFrame, log: DataFrame, at: str) -> DataFrame:
    """work with the version that is valid at its time; null before the first."""
    return asof(work, validity(log).select(F.col("since").alias("__since"), "version"), at, "__since", ["version"])


def routed(work: DataFrame, log: DataFrame, slices: DataFrame, at: str, key: str, cost: str) -> DataFrame:
    """at, version, slice_id, server, work (the sum of cost) and n, by the layout valid at each row's time; a key of several slices is shared by size.

    Work before the first version or of a key without a slice comes as rows without a server.
    """
    timed = version_at(work.select(at, key, cost), log, at)
    per = written(timed.groupBy(at, "version", key).agg(F.sum(cost).alias("__cost"), F.count(F.lit(1)).alias("__n")))
    keys = per.select("version", key).where("version IS NOT NULL").distinct()
    held = point_join(keys, slices.select("version", "slice_id", "lo", "hi", "size", "server"), key, by=("version",))
    own = Window.partitionBy("version", key)
    weight = F.col("size") / (F.col("hi") - F.col("lo"))
    share = held.withColumn("share", F.when(F.count(F.lit(1)).over(own) == 1, F.lit(1.0)).otherwise(weight / F.sum(weight).over(own)))
    out = per.join(share.select("version", key, "slice_id", "server", "share"), ["version", key], "left")
    out = out.groupBy(at, "version", "slice_id", "server").agg(F.sum(F.col("__cost") * F.coalesce("share", F.lit(1.0))).alias("work"), F.sum("__n").alias("n"))
    return out
