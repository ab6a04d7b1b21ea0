"""Routing: work of keys over slices to servers, and the loads that follow.

Shares of a key among its slices belong to the layout, so they are worked out there once; work is summed by (t, k)
before it meets them. What is shuffled is at most one row per tick and key, or per tick and slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EPS, ratio
from .layout import keymap

#: Part of a key's cost that its primary server bears beside the routed cost.
PRIMARY_BIAS = 0.35


def shares(slices: DataFrame) -> DataFrame:
    """k, slice_id, server, share: by size per key of the range."""
    weighted = keymap(slices).withColumn("w", F.greatest(F.lit(EPS), F.col("size") / F.col("span")))
    own = Window.partitionBy("k")
    share = F.when(F.count(F.lit(1)).over(own) == 1, F.lit(1.0)).otherwise(F.col("w") / F.sum("w").over(own))
    return weighted.withColumn("share", share).select("k", "slice_id", "server", "share")


def _onto(loads: DataFrame, table: DataFrame) -> DataFrame:
    """loads beside the table's rows (k, server, ...) of their key; a key that it does not have raises when the plan runs."""
    missing = F.raise_error(F.concat(F.lit("key without a slice: "), F.col("k").cast("string"))).cast("int")
    return loads.join(table, "k", "left").withColumn("server", F.coalesce("server", missing))


def cluster_loads(work: DataFrame) -> DataFrame:
    """t, k, load from (t, k, cost) rows."""
    return work.groupBy("t", "k").agg(F.sum("cost").alias("load"))


def allocate(work: DataFrame, slices: DataFrame) -> DataFrame:
    """t, k, slice_id, server, load: each key's cost over its slices. Keys without a slice raise, see unrouted()."""
    return _onto(cluster_loads(work), shares(slices)).select("t", "k", "slice_id", "server", (F.col("load") * F.col("share")).alias("load"))


def unrouted(work: DataFrame, slices: DataFrame) -> DataFrame:
    """Keys with work and no slice: a fault of the layout."""
    return work.select("k").distinct().join(keymap(slices), "k", "left_anti")


def require_routed(work: DataFrame, slices: DataFrame) -> None:
    if found := unrouted(work, slices).limit(5).collect():
        raise KeyError(f"keys without a slice: {[r[0] for r in found]}")


def slice_loads(work: DataFrame, slices: DataFrame) -> DataFrame:
    """t, slice_id, server, load; slices without work in a tick have load 0."""
    loads = allocate(work, slices).groupBy("t", "slice_id").agg(F.sum("load").alias("load"))
    return densified(loads, slices.select("slice_id", "server"), "slice_id", "load")


#: Members (servers, slices, keys) that may travel together in one broadcast row; there are as many in every tick of a dense table.
MEMBERS = 1_000_000


def gathered(members: DataFrame) -> DataFrame:
    """One row with all members as an array `m`; raises where there are more than MEMBERS."""
    n = F.count(F.lit(1))
    fits = F.when(n > MEMBERS, F.raise_error(F.concat(F.lit("too many members for one row: "), n.cast("string"))).cast("int"))
    return members.agg(fits.alias("__fits"), F.collect_list(F.struct(*members.columns)).alias("m")).where("__fits IS NULL").select("m")


def filled(ticks: DataFrame, members: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """A row for each tick and member; missing values are 0. The members travel as one array in one row."""
    everyone = gathered(members)
    grid = ticks.join(F.broadcast(everyone), F.lit(True)).select("t", F.explode("m").alias("m")).select("t", "m.*")
    return grid.join(values.select("t", key, value), ["t", key], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def densified(values: DataFrame, members: DataFrame, key: str, *value: str) -> DataFrame:
    """As filled, for the ticks of the values themselves: a tick's values gather in one list, at most one per member.

    The work is scanned once, and the result lies by t, so sums and extremes per tick need no further shuffle: zeros for
    all members are put beside a tick's values and summed where they lie.
    """
    cells = values.groupBy("t").agg(F.collect_list(F.struct(key, *value)).alias("__cells"))
    everyone = gathered(members)
    more = [c for c in members.columns if c != key]
    kinds = {f.name: f.dataType for f in members.schema.fields}
    zeros = F.transform("m", lambda e: F.struct(e[key].alias(key), *[F.lit(0.0).alias(v) for v in value], *[e[c].alias(c) for c in more], F.lit(1).alias("__own")))
    given = F.transform("__cells", lambda e: F.struct(e[key].alias(key), *[e[v].cast("double").alias(v) for v in value], *[F.lit(None).cast(kinds[c]).alias(c) for c in more], F.lit(0).alias("__own")))
    grid = cells.join(F.broadcast(everyone), F.lit(True)).select("t", F.explode(F.concat(given, zeros)).alias("e")).select("t", "e.*")
    out = grid.groupBy("t", key).agg(*[F.sum(v).alias(v) for v in value], *[F.max(c).alias(c) for c in more], F.max("__own").alias("__own"))
    return out.where("__own = 1").select("t", *members.columns, *value)


def weights(slices: DataFrame, primaries: DataFrame, bias: float = PRIMARY_BIAS) -> DataFrame:
    """k, server, share, weight: what of a key's cost a server's slices have, and that with the primary's bias."""
    own = shares(slices).select("k", "server", "share", F.col("share").alias("weight"))
    extra = primaries.select("k", "server", F.lit(0.0).alias("share"), F.lit(bias).alias("weight"))
    return own.unionByName(extra).groupBy("k", "server").agg(F.sum("share").alias("share"), F.sum("weight").alias("weight"))


def biased_work(work: DataFrame, slices: DataFrame, primaries: DataFrame, bias: float = PRIMARY_BIAS) -> DataFrame:
    """t, server, work: routed cost, and bias times each key's cost on its primary server."""
    routed = _onto(cluster_loads(work), weights(slices, primaries, bias))
    return routed.groupBy("t", "server").agg(F.sum(F.col("load") * F.col("weight")).alias("work"))


def server_ticks(work: DataFrame, slices: DataFrame, servers: DataFrame, primaries: DataFrame, bias: float = PRIMARY_BIAS) -> DataFrame:
    """t, server, capacity, load, work of every server and tick: server_loads and biased_work from one scan."""
    routed = _onto(cluster_loads(work), weights(slices, primaries, bias)).groupBy("t", "server")
    both = routed.agg(F.sum(F.col("load") * F.col("share")).alias("load"), F.sum(F.col("load") * F.col("weight")).alias("work"))
    return densified(both, servers.select("server", "capacity"), "server", "load", "work")


def of_server(values: DataFrame, server: int) -> DataFrame:
    """One server's rows of loads, utilisations or recent work."""
    return values.where(F.col("server") == server)


def server_loads(work: DataFrame, slices: DataFrame, servers: DataFrame) -> DataFrame:
    """t, server, capacity, load of every server, from its slices, in each tick with routed work."""
    loads = allocate(work, slices).groupBy("t", "server").agg(F.sum("load").alias("load"))
    return densified(loads, servers.select("server", "capacity"), "server", "load")


def utils(loads: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """t, server, util: load by capacity. Ticks without any slice load take the recent work of history (t, server, recent)."""
    total = F.sum("load").over(Window.partitionBy("t"))
    out = loads.withColumn("total", total)
    if history is not None:
        out = out.join(history.select("t", "server", "recent"), ["t", "server"], "left")
        out = out.withColumn("load", F.when(F.col("total") > EPS, F.col("load")).otherwise(F.coalesce("recent", F.lit(0.0))))
    return out.select("t", "server", ratio(F.col("load"), F.col("capacity")).alias("util"))


def recent_work(work: DataFrame, window: int, every: int = 0, touched: bool = False) -> DataFrame:
    """t, server, recent: work of the last `window` ticks; history starts anew after every `every` ticks.

    touched: only ticks in which a server had work count, and have rows.
    """
    work = work.where("work > 0") if touched else work
    epoch = F.floor((F.col("t") - 1) / every) if every > 0 else F.lit(0)
    frame = Window.partitionBy("server", "epoch").orderBy("t").rowsBetween(1 - window, 0)
    return work.withColumn("epoch", epoch).withColumn("recent", F.sum("work").over(frame)).select("t", "server", "recent")
