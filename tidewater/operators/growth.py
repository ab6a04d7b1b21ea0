"""Growth of popular clusters at rebalance ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EPS, half_even, uniform


def popular(loads: DataFrame, fraction: float, k: int = 0, by: tuple = ()) -> DataFrame:
    """k, load, place of the most loaded clusters: k of them, or a fraction of those with load, at least one."""
    order = Window.partitionBy(*by).orderBy(F.col("load").desc(), "k")
    ranked = loads.where("load > 0").withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    most = F.lit(k) if k > 0 else F.greatest(F.lit(1), half_even(F.col("n") * fraction))
    return ranked.where(F.col("place") <= most).drop("n")


def plan(chosen: DataFrame, sizes: DataFrame, frac: float, add: float, max_parts: int) -> DataFrame:
    """k, place, load_share, size_before, growth, parts: heavier clusters grow more than in proportion, in more parts."""
    everyone = Window.partitionBy()
    total, n = F.sum("load").over(everyone), F.count(F.lit(1)).over(everyone)
    out = chosen.withColumn("load_share", F.when(total > EPS, F.col("load") / total).otherwise(1 / n)).withColumn("n", n)
    out = out.join(sizes.select("k", F.col("size").alias("size_before")), "k")
    pull = F.col("load_share") * F.col("n")
    skew = pull + 0.5
    out = out.withColumn("growth", F.col("size_before") * frac * skew + add * F.greatest(F.lit(1.0), skew))
    parts = F.least(F.lit(max_parts), 1 + half_even((max_parts - 1) * F.least(F.lit(1.0), pull))).cast("int")
    return out.where("growth > 0").select("k", "place", "load", "load_share", "size_before", "growth", parts.alias("parts"))


def parts(planned: DataFrame, servers: Column, cursor: int, first_id: int) -> DataFrame:
    """k, slice_id, server, part, delta: new shards of unequal size, dealt to the servers (an array) in turn from the cursor on."""
    cut = planned.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("w", uniform(F.col("k"), F.col("part")) + 0.2)
    own = Window.partitionBy("k")
    cut = cut.withColumn("delta", F.col("growth") * F.col("w") / F.sum("w").over(own))
    nth = F.row_number().over(Window.orderBy("place", "part")) - 1
    at = ((F.lit(cursor) + F.col("nth")) % F.size(servers)).cast("int")
    cut = cut.withColumn("nth", nth).withColumn("server", F.element_at(servers, at + 1))
    return cut.select("k", (F.col("nth") + first_id).cast("long").alias("slice_id"), "server", "part", "delta")
