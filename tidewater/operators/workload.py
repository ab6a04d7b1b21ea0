"""Workloads: key popularity, bursts with hot sets, query modes and request volumes, as tables over ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_even, uniform
from .ordered import scanned


def zipf(spark: SparkSession, n: int, s: float, seed: int = 1) -> DataFrame:
    """Popularity of the keys 0 ... n - 1."""
    return popularity(spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("k")), s, seed)


def popularity(keys: DataFrame, s: float, seed: int = 1) -> DataFrame:
    """k, prob: weights 1 / rank ** s in a repeatable shuffle of the keys, summing to 1."""
    rank = F.row_number().over(Window.orderBy(uniform(F.col("k"), F.lit(seed)), "k"))
    weight = keys.select("k").withColumn("w", 1 / F.pow(rank.cast("double"), F.lit(s)))
    return weight.select("k", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("prob"))


def request_bounds(servers: Column, per_server: Column, spread: float = 0.2) -> dict[str, Column]:
    """Mean, deviation, least and most requests of a tick."""
    mean = servers * per_server
    std = half_even(mean * spread)
    low = F.greatest(F.lit(1), mean - 3 * std)
    return {"requests_mean": mean.cast("long"), "requests_std": std, "requests_min": low.cast("long"), "requests_max": F.greatest(low, mean + 3 * std).cast("long")}


def volume(gauss: Column, mean: Column, std: Column, low: Column, high: Column) -> Column:
    """Requests of a tick from a standard normal value, rounded half to even and kept within bounds."""
    return F.least(high, F.greatest(low, half_even(mean + std * gauss)))


def query_ids(requests: DataFrame) -> DataFrame:
    """t, n_requests, first_qid, last_qid: queries are numbered over all ticks."""
    upto = scanned(requests.select("t", F.col("n_requests").cast("long").alias("n_requests")), ["t"], {"last_qid": F.col("n_requests")})
    return upto.select("t", "n_requests", (F.col("last_qid") - F.col("n_requests") + 1).alias("first_qid"), "last_qid")


def queries(requests: DataFrame) -> DataFrame:
    """A row for each query: t, qid. Only where single requests are wanted."""
    return query_ids(requests).where("n_requests > 0").select("t", F.explode(F.sequence("first_qid", "last_qid")).alias("qid"))


def spikes(qids: DataFrame, n_keys: int, every: int, duration: int, n_hot: int) -> DataFrame:
    """qid, epoch, active, hot: in the first `duration` queries of each `every`, n_hot keys of the epoch's shuffle are hot."""
    epochs = qids.select(F.floor((F.col("qid") - 1) / every).alias("epoch")).distinct()
    keyed = epochs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_keys - 1))))
    nth = F.row_number().over(Window.partitionBy("epoch").orderBy(uniform(F.col("k"), F.col("epoch")), "k"))
    hot = keyed.withColumn("nth", nth).where(F.col("nth") <= n_hot).groupBy("epoch").agg(F.sort_array(F.collect_list("k")).alias("hot"))
    out = qids.withColumn("epoch", F.floor((F.col("qid") - 1) / every)).withColumn("active", ((F.col("qid") - 1) % every < duration))
    return out.join(hot, "epoch").select("qid", "epoch", "active", F.when(F.col("active"), F.col("hot")).otherwise(F.array().cast("array<int>")).alias("hot"))


def hot_weights(ranked: DataFrame, skew: float, by: tuple = ("burst_id",)) -> DataFrame:
    """weight of each hot key from its place (1, 2, ...) in the burst's hot set: place ** -skew, normalised."""
    own = Window.partitionBy(*by)
    raw = ranked.withColumn("w", F.pow(F.col("place").cast("double"), F.lit(-skew)))
    return raw.withColumn("weight", F.col("w") / F.sum("w").over(own)).drop("w")


def burst_length(gauss: Column, mean: float, std: float, low: int, high: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(high), F.greatest(F.lit(low), half_even(F.lit(mean) + F.lit(std) * gauss))))


def burst_ranges(bursts: DataFrame) -> DataFrame:
    """burst_id, burst_len, first_t, last_t from (burst_id, burst_len): bursts follow each other without gaps."""
    upto = scanned(bursts.select("burst_id", F.col("burst_len").cast("long").alias("burst_len")), ["burst_id"], {"last_t": F.col("burst_len")})
    return upto.select("burst_id", "burst_len", (F.col("last_t") - F.col("burst_len") + 1).alias("first_t"), "last_t")


def burst_ticks(bursts: DataFrame) -> DataFrame:
    """t, burst_id, burst_start, burst_len, burst_remaining; remaining counts the tick itself."""
    out = burst_ranges(bursts).withColumn("t", F.explode(F.sequence("first_t", "last_t")))
    return out.select("t", "burst_id", (F.col("t") == F.col("first_t")).cast("int").alias("burst_start"), "burst_len", (F.col("last_t") - F.col("t") + 1).alias("burst_remaining"))


def burst_modes(bursts: DataFrame, alternative: Column) -> DataFrame:
    return bursts.withColumn("burst_mode", F.when(alternative, F.lit("alt")).otherwise(F.lit("primary")))


def fixed_hot(ids: Column, n_keys: int, n_hot: int) -> Column:
    """A given hot set: distinct keys of the range; where it is short, the smallest other keys fill it up."""
    own = F.array_distinct(F.filter(ids, lambda x: (x >= 0) & (x < n_keys)))
    rest = F.array_except(F.sequence(F.lit(0), F.lit(n_keys - 1)), own)
    return F.slice(F.concat(own, rest), 1, n_hot)


def distribution_modes(ticks: DataFrame, switch: str = "dist_switch", first: str = "zipf") -> DataFrame:
    """t, dist_switch, dist_id, dist_mode: each switch flips between zipf and uniform."""
    other = "uniform" if first == "zipf" else "zipf"
    out = scanned(ticks, ["t"], {"dist_id": F.col(switch).cast("long")}).withColumn("dist_id", F.col("dist_id").cast("int"))
    return out.withColumn("dist_mode", F.when(F.col("dist_id") % 2 == 0, F.lit(first)).otherwise(F.lit(other)))


def payload(raw: Column) -> Column:
    """A query's payload from JSON, with defaults for what is missing."""
    schema = "hot array<int>, hot_weights array<double>, hot_mass double, burst_id int, burst_start int, burst_mode string, burst_len int, burst_remaining int, dist_mode string, dist_switch int, dist_id int"
    p = F.from_json(raw, schema)
    numbers = [F.coalesce(p[c], F.lit(0)).alias(c) for c in ("burst_id", "burst_start", "burst_len", "burst_remaining", "dist_switch", "dist_id")]
    return F.struct(
        F.coalesce(p["hot"], F.array().cast("array<int>")).alias("hot"),
        F.coalesce(p["hot_weights"], F.array().cast("array<double>")).alias("hot_weights"),
        F.coalesce(p["hot_mass"], F.lit(0.0)).alias("hot_mass"),
        F.coalesce(p["burst_mode"], F.lit("")).alias("burst_mode"),
        F.coalesce(p["dist_mode"], F.lit("zipf")).alias("dist_mode"),
        *numbers,
    )


def batch(requests: DataFrame, payload: str = "payload", locked: bool = True) -> DataFrame:
    """Requests (t, request, payload) of whole ticks: locked, all of a tick share the payload of its first request; else each has its own."""
    if not locked:
        return requests
    first = requests.groupBy("t").agg(F.min_by(payload, "request").alias("__shared"))
    return requests.join(first, "t").withColumn(payload, F.col("__shared")).drop("__shared")


def vectors(ids: DataFrame, dim: int) -> DataFrame:
    """qid, vector of repeatable uniform numbers."""
    return ids.select("qid", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: uniform(F.col("qid"), i)).alias("vector"))
