"""Probe planning: hot and cold shares, apportionment of counts, and weighted draws.

Counts are planned for whole ticks, (t, k, cnt), not for single requests: apportionment gives what that many draws
would give on average, and sums exactly. Draws take their randomness as a column, so they can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EPS, half_even
from ..sources.shared import written
from .ordered import first_rows
from .routing import gathered


def normalized(weights: DataFrame, weight: str = "weight", by: tuple = ()) -> DataFrame:
    """With prob: weights that are missing, negative or no number count as 0; if all are 0, all are equal."""
    own = Window.partitionBy(*by)
    w = F.greatest(F.lit(0.0), F.coalesce(F.col(weight).try_cast("double"), F.lit(0.0)))
    out = weights.withColumn("__w", F.when(F.isnan(w), 0.0).otherwise(w))
    total = F.sum("__w").over(own)
    return out.withColumn("prob", F.when(total > EPS, F.col("__w") / total).otherwise(1 / F.count(F.lit(1)).over(own))).drop("__w")


def clean_hot(hot: Column, n_keys: int) -> Column:
    """Hot keys as distinct integers of the key range, in their order."""
    return F.array_distinct(F.filter(F.transform(hot, lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x >= 0) & (x < n_keys)))


def hot_cold_split(target: Column, hot_mass: Column, n_hot: Column) -> tuple[Column, Column]:
    """How many of target probes go to hot keys and how many to the rest."""
    hot = F.when(n_hot > 0, F.greatest(F.lit(0), F.least(target, half_even(hot_mass * target)))).otherwise(F.lit(0)).cast("long")
    return hot, (target - hot).cast("long")


def probes(nprobe: int, jitter: Column | None = None) -> Column:
    return F.greatest(F.lit(1), F.lit(nprobe) + (F.lit(0) if jitter is None else jitter))


def even_split(items: DataFrame, n: Column, by: tuple = (), order: str = "k") -> DataFrame:
    """cnt per item: n // items for each, one more for the first n % items."""
    own = Window.partitionBy(*by)
    m = F.count(F.lit(1)).over(own)
    nth = F.row_number().over(own.orderBy(order))
    share = F.floor(n / m)
    return items.withColumn("cnt", (share + (nth <= n - share * m).cast("int")).cast("long"))


def apportion(items: DataFrame, n: Column, by: tuple = (), prob: str = "prob", order: str = "k") -> DataFrame:
    """cnt per item by largest remainders: floors of n * prob, then one more by falling fraction, ties by order. Sums to n."""
    own = Window.partitionBy(*by)
    expected = n * F.col(prob)
    out = items.withColumn("__n", n).withColumn("__floor", F.floor(F.round(expected, 9))).withColumn("__frac", F.round(expected - F.col("__floor"), 9))
    left = F.col("__n") - F.sum("__floor").over(own)
    nth = F.row_number().over(own.orderBy(F.col("__frac").desc(), order))
    return out.withColumn("cnt", (F.col("__floor") + (nth <= left).cast("int")).cast("long")).drop("__n", "__floor", "__frac")


def apportion_large(items: DataFrame, n: Column, by: tuple = (), prob: str = "prob", order: str = "k") -> DataFrame:
    """As apportion(), for groups that no task holds: the items that get one more are found by ranks, not by sorting the group."""
    expected = n * F.col(prob)
    out = items.withColumn("__n", n.cast("long")).withColumn("__floor", F.floor(F.round(expected, 9)).cast("long")).withColumn("__less", F.round(F.floor(F.round(expected, 9)) - expected, 9))
    out = written(out)
    left = out.groupBy(*by).agg((F.first("__n") - F.sum("__floor")).alias("__left"))
    out = out.join(left, list(by)) if by else out.join(F.broadcast(left), F.lit(True))
    more = first_rows(out, F.col("__left"), ["__less", order], by).select(*by, order, F.lit(1).alias("__one"))
    cnt = F.col("__floor") + F.coalesce("__one", F.lit(0))
    return out.join(more, [*by, order], "left").withColumn("cnt", cnt.cast("long")).select(*items.columns, "cnt")


def cold_pool(keys: DataFrame, hot: DataFrame, ticks: DataFrame) -> DataFrame:
    """t, k, prob of the keys that are not hot in a tick, probabilities renormalised. ticks: t and what else is to be kept."""
    everyone = gathered(keys.select("k", "prob"))
    grid = ticks.join(F.broadcast(everyone), F.lit(True)).select(*ticks.columns, F.explode("m").alias("m")).select(*ticks.columns, "m.k", "m.prob")
    cold = grid.join(hot.select("t", "k"), ["t", "k"], "left_anti")
    return normalized(cold.withColumnRenamed("prob", "weight"), by=("t",)).drop("weight")


def plan_counts(requests: DataFrame, keys: DataFrame, hot: DataFrame, nprobe: int) -> DataFrame:
    """t, k, cnt of whole ticks.

    requests: t, n_requests, hot_mass, dist_mode ('zipf' or 'uniform', for the cold keys); keys: k, prob; hot: t, k, weight.
    """
    requests, hot = written(requests), written(hot.select("t", "k", "weight"))
    n_hot = hot.groupBy("t").agg(F.count(F.lit(1)).alias("n_hot"))
    ticks = requests.join(n_hot, "t", "left").withColumn("target", F.col("n_requests") * nprobe)
    to_hot, to_cold = hot_cold_split(F.col("target"), F.col("hot_mass"), F.coalesce("n_hot", F.lit(0)))
    ticks = ticks.select("t", "dist_mode", to_hot.alias("to_hot"), to_cold.alias("to_cold"))
    # hot and cold keys are two groups of a tick; flat ones are keys of one weight
    cold = cold_pool(keys, hot, ticks).select("t", "k", F.when(F.col("dist_mode") == "uniform", 1.0).otherwise(F.col("prob")).alias("weight"), F.col("to_cold").alias("n"), F.lit(False).alias("is_hot"))
    pool = hot.join(ticks, "t").select("t", "k", "weight", F.col("to_hot").alias("n"), F.lit(True).alias("is_hot")).unionByName(cold)
    return apportion(normalized(pool, by=("t", "is_hot")), F.col("n"), by=("t", "is_hot")).select("t", "k", "cnt").where("cnt > 0")


def cost_of(counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """t, k, cost; clusters: k, cost per probe."""
    return counts.where("cnt > 0").join(clusters.select("k", F.col("cost").alias("unit")), "k").select("t", "k", (F.col("unit") * F.col("cnt")).alias("cost"))


#: Cells of [0, 1) by which draws find their items.
CELLS = 1024


def inverse_cdf(draws: DataFrame, items: DataFrame, u: str = "u", by: tuple = ()) -> DataFrame:
    """draws with the item k whose share of [0, 1) holds u; items: k, prob.

    [0, 1) is cut into CELLS equal cells; an item stands in each cell that its span touches, and a draw is joined by its
    cell. So a draw meets the few items of its cell, and draws are spread by cell, too. The last item's span has no end.
    """
    order = Window.partitionBy(*by).orderBy("k")
    last = F.lead("k").over(order).isNull()
    table = items.withColumn("__upto", F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    table = table.withColumn("__from", F.coalesce(F.lag("__upto").over(order), F.lit(-1.0))).withColumn("__upto", F.when(last, F.lit(2.0)).otherwise(F.col("__upto")))
    cell = lambda x: F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(x * CELLS))).cast("int")
    table = table.select(*by, "k", "__from", "__upto", F.explode(F.sequence(cell(F.col("__from")), cell(F.col("__upto")))).alias("__cell"))
    found = draws.withColumn("__cell", cell(F.col(u))).join(table, [*by, "__cell"])
    return found.where((F.col(u) > F.col("__from")) & (F.col(u) <= F.col("__upto"))).drop("__cell", "__from", "__upto")


def sample_without_replacement(items: DataFrame, n: int, u: Column, by: tuple = ()) -> DataFrame:
    """n items of each group, chances by weight: the smallest exponential keys -ln(u) / weight."""
    key = -F.ln(F.greatest(u, F.lit(1e-300))) / F.col("weight")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("__key", "k"))
    return items.where("weight > 0").withColumn("__key", key).withColumn("nth", nth).where(F.col("nth") <= n).drop("__key")


def request_plans(requests: DataFrame, keys: DataFrame, hot: DataFrame, nprobe: int, repeat: bool = False) -> DataFrame:
    """t, request, k, cnt: the probes of single requests. requests: t, request, hot_mass, seed; hot: t, k, weight.

    Hot and cold keys are drawn apart: with repeats by inverse CDF, without by weighted sampling.
    """
    from ..functions.numbers import uniform

    n_hot = hot.groupBy("t").agg(F.count(F.lit(1)).alias("n_hot"))
    base = requests.join(n_hot, "t", "left").withColumn("n_hot", F.coalesce("n_hot", F.lit(0)))
    to_hot, _ = hot_cold_split(F.lit(nprobe), F.col("hot_mass"), F.col("n_hot"))
    base = base.withColumn("to_hot", to_hot if repeat else F.least(to_hot, F.col("n_hot")))
    cold = cold_pool(keys, hot, requests.select("t").distinct())
    pools = normalized(hot, by=("t",)).select("t", "k", "prob", F.lit(True).alias("is_hot")).unionByName(cold.select("t", "k", "prob", F.lit(False).alias("is_hot")))
    if repeat:
        drawn = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nprobe - 1)))).withColumn("is_hot", F.col("i") < F.col("to_hot"))
        drawn = drawn.withColumn("u", uniform(F.col("seed"), F.col("i")))
        return inverse_cdf(drawn, pools, by=("t", "is_hot")).groupBy("t", "request", "k").agg(F.count(F.lit(1)).alias("cnt"))
    # a request ranks its tick's keys in an array: no row for each request and key is made
    key = lambda e: -F.ln(F.greatest(uniform(F.col("seed"), e["k"]), F.lit(1e-9))) / e["prob"]
    first = lambda pool, n: F.slice(F.array_sort(F.transform(pool, lambda e: F.struct(key(e).alias("key"), e["k"].alias("k")))), F.lit(1), n)
    some = lambda flag: F.collect_list(F.when(F.col("is_hot") == flag, F.struct("k", "prob")))
    lists = pools.groupBy("t").agg(some(True).alias("hot_pool"), some(False).alias("cold_pool"))
    to_hot = F.col("to_hot").cast("int")
    drawn = base.join(lists, "t").select("t", "request", F.explode(F.concat(first("hot_pool", to_hot), first("cold_pool", F.lit(nprobe) - to_hot))).alias("e"))
    return drawn.select("t", "request", "e.k", F.lit(1).cast("long").alias("cnt"))


#: Streams of draws that do not meet those of the requests themselves.
SAMPLE = 1 << 40


def sampled_plans(ticks: DataFrame, keys: DataFrame, hot: DataFrame, nprobe: int, limit: int, repeat: bool = True) -> DataFrame:
    """t, request, k, cnt of min(n_requests, limit) further requests of each tick. ticks: t, n_requests, hot_mass.

    Their draws are keyed by numbers from SAMPLE on, so that taking samples changes no draw of the run.
    """
    one = F.explode(F.sequence(F.lit(0), F.least(F.col("n_requests"), F.lit(limit)).cast("int") - 1))
    requests = ticks.where("n_requests > 0").select("t", one.alias("request"), "hot_mass")
    requests = requests.withColumn("seed", F.lit(SAMPLE) + F.col("t").cast("long") * F.lit(1 << 20) + F.col("request"))
    return request_plans(requests, keys, hot, nprobe, repeat)


def sampled_demand(plans: DataFrame) -> DataFrame:
    """t, k, demand: probes of a key per sampled request of the tick; what a min-max assignment goes by."""
    n = plans.groupBy("t").agg(F.countDistinct("request").alias("__n"))
    return plans.groupBy("t", "k").agg(F.sum("cnt").alias("demand")).join(n, "t").select("t", "k", (F.col("demand") / F.col("__n")).alias("demand"))
