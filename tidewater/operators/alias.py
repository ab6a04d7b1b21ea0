"""Alias tables: weighted draws by one look at a slot, from tables of any size.

A group of n items of total weight S has n slots. A slot belongs to an item, which keeps `keep` of the S parts of the
slot and leaves the rest to its alias, so that each item has in all what its weight asks for. Items under the average
are filled up by those over it, in the order of the items; as both are met in order, who fills whom follows from running
sums of what is lacking and of what is over, by looking up the next sum. So a table is built by scans over ranges, and
no group has to fit a task. Everything is in whole numbers, so tables are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordered import _beside, asof, scanned


def alias_table(items: DataFrame, weight: str = "weight", key: str = "k", by: tuple = ()) -> DataFrame:
    """by..., slot (from 0), k, keep, alias, n, total of each item. weight: whole numbers; null and negative ones count as 0.

    If all weights of a group are 0, all are equal. n * total of a group has to stay under 2**62: choose the unit of the
    weights so, as sums of that size are met.
    """
    own = items.select(*by, F.col(key).alias("k"), F.greatest(F.lit(0), F.coalesce(F.col(weight).cast("long"), F.lit(0))).alias("w"))
    totals = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"))
    totals = written(totals.withColumn("even", F.col("total") == 0).withColumn("total", F.when(F.col("even"), F.col("n")).otherwise(F.col("total"))))
    if (most := totals.agg(F.max(F.col("n").cast("double") * F.col("total"))).first()[0]) and most >= 2.0**62:
        raise ValueError("n * total of a group reaches 2**62: take weights in a larger unit")
    rows = _beside(own, totals, by).withColumn("w", F.when(F.col("even"), F.lit(1)).otherwise(F.col("w"))).drop("even")
    gap = F.col("w") * F.col("n") - F.col("total")
    sums = {"lacking": F.greatest(F.lit(0), -gap), "over": F.greatest(F.lit(0), gap), "slot": F.lit(1).cast("long")}
    rows = written(scanned(rows.withColumn("gap", gap), ["k"], sums, by=by).withColumn("slot", F.col("slot") - 1))
    light = rows.where("gap < 0").withColumn("from", F.col("lacking") + F.col("gap"))
    heavy = rows.where("gap >= 0")
    # a light slot is filled by the first heavy item that is not used up where it begins
    filled = asof(light, heavy.select(*by, F.col("over").alias("__over"), F.col("k").alias("alias")), "from", "__over", ["alias"], by, following=True, strict=True, ties=["alias"])
    filled = filled.select(*by, "slot", "k", (F.col("w") * F.col("n")).alias("keep"), "alias", "n", "total")
    # a heavy item is used up where the light ones have reached it; what it lacks then comes from the next heavy one
    ends = asof(heavy, light.select(*by, F.col("lacking").alias("closed")).withColumn("__at", F.col("closed")), "over", "__at", ["closed"], by, following=True)
    closed = F.when(F.col("over") == 0, F.lit(0)).otherwise(F.coalesce("closed", "over"))
    ends = ends.withColumn("keep", F.col("total") + F.col("over") - closed)
    after = asof(ends, heavy.select(*by, F.col("k").alias("alias")).withColumn("__k", F.col("alias")), "k", "__k", ["alias"], by, following=True, strict=True)
    after = after.select(*by, "slot", "k", "keep", F.coalesce("alias", "k").alias("alias"), "n", "total")
    return filled.unionByName(after)


def alias_draw(draws: DataFrame, table: DataFrame, u: Column, v: Column, by: tuple = ()) -> DataFrame:
    """draws with k: u picks the slot, v the item or its alias; both in [0, 1) and independent of each other."""
    sizes = table.groupBy(*by).agg(F.first("n").alias("__n"))
    slots = table.select(*by, F.col("slot").alias("__slot"), "k", "keep", "alias", "total")
    at = _beside(draws.withColumns({"__u": u, "__v": v}), sizes, by).withColumn("__slot", F.floor(F.col("__u") * F.col("__n")))
    found = at.join(slots, [*by, "__slot"])
    own = F.floor(F.col("__v") * F.col("total")) < F.col("keep")
    return found.select(*draws.columns, F.when(own, F.col("k")).otherwise(F.col("alias")).alias("k"))
