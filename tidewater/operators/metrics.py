"""Metrics of ticks: imbalance, extremes, fan-out, hot probes, latency and heat, run summaries.

Windows over t alone hold one row per tick; give `by` (a scenario column) to keep series of several runs apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..sources.shared import written
from .ordered import nth_value, numbered, sliding

#: Latency per unit of work and heat, heat per unit of work, decay of heat per tick.
ALPHA, BETA, DECAY = 0.0005, 0.01, 0.02


def imbalance(values: DataFrame, value: str = "util", name: str = "imbalance") -> DataFrame:
    """t and max / mean over all servers; 0 where the mean is nothing."""
    return values.groupBy("t").agg(ratio(F.max(value), F.avg(value)).alias(name))


def extremes(values: DataFrame, key: str, value: str, high: str, low: str) -> DataFrame:
    """t, the members of the greatest and least value, and both values; ties go to the smallest member."""
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(key)).alias("k")))
    least = F.min(F.struct(F.col(value).alias("v"), F.col(key).alias("k")))
    out = values.groupBy("t").agg(top.alias("top"), least.alias("least"))
    return out.select("t", (-F.col("top.k")).alias(high), F.col("top.v").alias(f"{high}_value"), F.col("least.k").alias(low), F.col("least.v").alias(f"{low}_value"))


def fanout(work: DataFrame) -> DataFrame:
    """Servers that a tick's routed work reaches."""
    return work.groupBy("t").agg(F.countDistinct("server").cast("double").alias("fanout"))


def request_fanouts(probes: DataFrame, keymap: DataFrame, primaries: DataFrame | None = None) -> DataFrame:
    """t, request, fanout: servers that hold any slice of any probed key; with primaries (k, server) those of the keys too."""
    places = keymap.select("k", "server")
    places = places if primaries is None else places.unionByName(primaries.select("k", "server"))
    return probes.join(places.distinct(), "k").groupBy("t", "request").agg(F.countDistinct("server").cast("double").alias("fanout"))


def fanout_stats(fanouts: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Figures of the requests' fan-outs per tick; ticks (t, fanout) without a request have their own fan-out, and no variance."""
    if ticks is not None:
        stats = ticks.join(fanout_stats(fanouts), "t", "left")
        own = [F.coalesce(f"fanout_req_{x}", "fanout").alias(f"fanout_req_{x}") for x in ("mean", "min", "max")]
        return stats.select("t", F.coalesce("fanout_req_samples", F.lit(0)).alias("fanout_req_samples"), *own, F.coalesce("fanout_req_var", F.lit(0.0)).alias("fanout_req_var"))
    return fanouts.groupBy("t").agg(
        F.count(F.lit(1)).alias("fanout_req_samples"),
        F.avg("fanout").alias("fanout_req_mean"),
        F.min("fanout").alias("fanout_req_min"),
        F.max("fanout").alias("fanout_req_max"),
        F.var_pop("fanout").alias("fanout_req_var"),
    )


def rolling_variance(series: DataFrame, value: str, window: int, burn_in: int = 0, by: tuple = ()) -> Column:
    """Population variance of the last `window` rows; 0 in the burn-in and for a first row."""
    order = Window.partitionBy(*by).orderBy("t")
    n = F.row_number().over(order)
    return F.when((F.col("t") > burn_in) & (n >= 2), F.var_pop(value).over(order.rowsBetween(1 - window, 0))).otherwise(F.lit(0.0))


def rolling_variances(series: DataFrame, value: str, window: int, burn_in: int = 0) -> DataFrame:
    """t, variance: as rolling_variance(), of one series of any length: no task has more than a chunk of it."""
    found = numbered(sliding(series.select("t", value), ["t"], value, window), ["t"], "__n")
    return found.select("t", F.when((F.col("t") > burn_in) & (F.col("__n") >= 2), F.col("sd") * F.col("sd")).otherwise(F.lit(0.0)).alias("variance"))


def hot_ratio(counts: DataFrame, hot: DataFrame) -> DataFrame:
    """t, work_units, hot_probe_ratio from probe counts (t, k, cnt) and hot keys (t, k)."""
    marked = counts.join(hot.select("t", "k", F.lit(1).alias("is_hot")).distinct(), ["t", "k"], "left")
    out = marked.groupBy("t").agg(F.sum("cnt").alias("work_units"), F.sum(F.when(F.col("is_hot") == 1, F.col("cnt")).otherwise(0)).alias("hits"))
    return out.select("t", "work_units", F.when(F.col("work_units") > 0, F.col("hits") / F.col("work_units")).otherwise(0.0).alias("hot_probe_ratio"))


def _cooled(order) -> Column:
    """Heat that a tick finds: that of the row before, less what ticks without a row have cooled; 0 at first."""
    gap = F.col("t") - 1 - F.lag("t").over(order)
    return F.coalesce(F.lag("heat").over(order) * F.pow(F.lit(1 - DECAY), gap), F.lit(0.0))


def heat(work: DataFrame, chunk: int = 2000) -> DataFrame:
    """t, server, work, latency, heat from servers' work in ticks (t = 1, 2, ...); in ticks without a row a server only cools.

    A tick costs work * (1 + ALPHA * heat before it); then heat grows by BETA * work and decays. As a linear recurrence
    it has a closed form per chunk of ticks; what a chunk leaves behind is carried to the later ones, so the powers
    stay in range for any number of ticks.
    """
    if chunk < 1000:
        raise ValueError("chunks of under 1000 ticks do not fade within two chunks")
    q = 1 - DECAY
    n = F.col("t") - F.col("chunk") * chunk  # 1 ... chunk
    base = work.withColumn("chunk", F.floor((F.col("t") - 1) / chunk).cast("long"))
    own = Window.partitionBy("server", "chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    fresh = base.withColumn("n", n).withColumn("own", F.pow(F.lit(q), F.col("n") + 1) * F.sum(BETA * F.col("work") * F.pow(F.lit(q), -F.col("n"))).over(own))
    # chunks fade to nothing: q ** chunk is 3e-18, so what the last two left is all that counts
    fresh = fresh.withColumn("end", F.col("own") * F.pow(F.lit(q), chunk - F.col("n")))
    left = lambda k: F.max_by("end", "t").over(Window.partitionBy("server").orderBy("chunk").rangeBetween(-k, -k))
    fresh = fresh.withColumn("left1", left(1)).withColumn("left2", left(2))
    carried = F.coalesce("left1", F.lit(0.0)) + F.coalesce("left2", F.lit(0.0)) * q**chunk
    out = fresh.withColumn("heat", F.col("own") + carried * F.pow(F.lit(q), F.col("n")))
    cold = _cooled(Window.partitionBy("server").orderBy("t"))
    return out.withColumn("latency", F.col("work") * (1 + ALPHA * cold)).select("t", "server", "work", "latency", "heat")


def worked(work: DataFrame, every: int = 0) -> DataFrame:
    """t, server, cumulative_work, window_work: a server's work up to the tick, and since the last rebalance (every `every` ticks)."""
    upto = Window.partitionBy("server").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.floor((F.col("t") - 1) / every) if every > 0 else F.lit(0)
    own = Window.partitionBy("server", "__epoch").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = work.withColumn("__epoch", epoch)
    return out.select("t", "server", F.sum("work").over(upto).alias("cumulative_work"), F.sum("work").over(own).alias("window_work"))


def request_latency(routed: DataFrame) -> DataFrame:
    """t, request, server, work, latency of single requests (t, request, server, work), served in the order of their numbers.

    Within a tick a server heats up with each request; it cools once, at the tick's end. So a request finds the heat of
    the ticks before it and BETA times the work that the tick has brought the server so far.
    """
    ticks = routed.select("t").distinct()
    per = routed.groupBy("t", "server").agg(F.sum("work").alias("work"))
    grid = ticks.join(F.broadcast(per.agg(F.collect_set("server").alias("m"))), F.lit(True)).select("t", F.explode("m").alias("server"))
    whole = grid.join(per, ["t", "server"], "left").na.fill(0.0, ["work"])
    order = Window.partitionBy("server").orderBy("t")
    start = heat(whole).select("server", "t", _cooled(order).alias("start"))
    so_far = Window.partitionBy("t", "server").orderBy("request").rowsBetween(Window.unboundedPreceding, -1)
    out = routed.withColumn("before", F.coalesce(F.sum("work").over(so_far), F.lit(0.0))).join(start, ["t", "server"])
    return out.select("t", "request", "server", "work", (F.col("work") * (1 + ALPHA * (F.col("start") + BETA * F.col("before")))).alias("latency"))


def p95(series: DataFrame, value: str, by: tuple = ()) -> DataFrame:
    """The value at rank floor(0.95 * (n - 1)) from 0, without interpolation; no group is sorted."""
    own = written(series.select(*by, value))
    return nth_value(own, value, lambda n: F.floor(F.lit(0.95) * (n - 1)), by).select(*by, F.col(value).alias(f"p95_{value}"))


def summary(latency: DataFrame, imbalances: DataFrame, heats: DataFrame) -> DataFrame:
    """One row: average and p95 latency, last imbalance, and the hottest server with its heat."""
    last = imbalances.agg(F.max_by("imbalance", "t").alias("imbalance"))
    final = heats.groupBy("server").agg(F.max_by("heat", "t").alias("heat"))
    hot = final.agg(F.max(F.struct("heat", (-F.col("server")).alias("s"))).alias("h")).select((-F.col("h.s")).alias("hottest_server"), F.col("h.heat").alias("max_server_heat"))
    mean = latency.agg(F.avg("latency").alias("avg_latency"))
    out = mean
    for one_row in (p95(latency, "latency"), last, hot):
        out = out.join(F.broadcast(one_row), F.lit(True))
    return out


def before(series: DataFrame, value: str, first: Column | None = None) -> Column:
    """The value of the tick before; for the first tick the given one, or 0."""
    return F.coalesce(F.lag(value).over(Window.orderBy("t")), F.lit(0.0) if first is None else first)


def wide(values: DataFrame, servers: list[int], measures: list[str]) -> DataFrame:
    """A row per tick with a column measure_s<server> for each measure and server of the list."""
    out = values.groupBy("t").pivot("server", servers).agg(*[F.first(m).alias(m) for m in measures])
    if len(measures) == 1:
        return out.select("t", *[F.col(str(s)).alias(f"{measures[0]}_s{s}") for s in servers])
    return out.select("t", *[F.col(f"{s}_{m}").alias(f"{m}_s{s}") for m in measures for s in servers])

