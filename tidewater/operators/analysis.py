"""Series for figures: hot and cold workload, candles, markers, comparisons of scenarios."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import sliding


def hot_cold_workload(loads: DataFrame, hot: DataFrame, totals: DataFrame) -> DataFrame:
    """t, hot, cold, primary, secondary: load of the hot keys, the rest of the tick's workload, and the two largest hot loads."""
    on = loads.join(hot.select("t", "k").distinct(), ["t", "k"])
    nth = F.row_number().over(Window.partitionBy("t").orderBy(F.col("load").desc(), "k"))
    two = on.withColumn("nth", nth).groupBy("t").agg(F.sum("load").alias("hot"), F.max(F.when(F.col("nth") == 1, F.col("load"))).alias("primary"), F.max(F.when(F.col("nth") == 2, F.col("load"))).alias("secondary"))
    out = totals.join(two, "t", "left").na.fill(0.0, ["hot", "primary", "secondary"])
    return out.select("t", "hot", F.greatest(F.lit(0.0), F.col("workload") - F.col("hot")).alias("cold"), "primary", "secondary")


def probe_units(series: DataFrame) -> DataFrame:
    """t, hot_probe_units, cold_probe_units from a series' work_units and hot_probe_ratio."""
    hot = F.col("work_units") * F.col("hot_probe_ratio")
    return series.select("t", hot.alias("hot_probe_units"), F.greatest(F.lit(0.0), F.col("work_units") * (1 - F.col("hot_probe_ratio"))).alias("cold_probe_units"))


def rolling_candles(series: DataFrame, value: str, window: int) -> DataFrame:
    """t, low, open, close, high over the last `window` rows: mean less and plus one deviation, within the range."""
    out = sliding(series.select("t", value), ["t"], value, window)
    return out.select("t", "low", F.greatest(F.col("low"), F.col("mean") - F.col("sd")).alias("open"), F.least(F.col("high"), F.col("mean") + F.col("sd")).alias("close"), "high")


def request_candles(stats: DataFrame, window: int) -> DataFrame:
    """Candles of each tick's request fan-outs; without any samples at all, rolling ones of the mean.

    stats: t, fanout_req_samples, fanout_req_mean, fanout_req_min, fanout_req_max, fanout_req_var.
    """
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("fanout_req_var")))
    own = stats.select("t", F.col("fanout_req_min").alias("low"), F.greatest(F.col("fanout_req_min"), F.col("fanout_req_mean") - sd).alias("open"), F.least(F.col("fanout_req_max"), F.col("fanout_req_mean") + sd).alias("close"), F.col("fanout_req_max").alias("high"))
    sampled = stats.agg((F.coalesce(F.max("fanout_req_samples"), F.lit(0)) > 0).alias("sampled"))
    both = own.withColumn("of", F.lit(True)).unionByName(rolling_candles(stats, "fanout_req_mean", window).withColumn("of", F.lit(False)))
    return both.join(F.broadcast(sampled), F.col("of") == F.col("sampled")).drop("of", "sampled")


def direction(series: DataFrame, value: str) -> DataFrame:
    """t, value, up: not below the value before; the first is up."""
    prev = F.lag(value).over(Window.orderBy("t"))
    return series.select("t", value, (F.col(value) >= F.coalesce(prev, F.col(value))).alias("up"))


def markers(series: DataFrame, label: str = "rebalance") -> DataFrame:
    """t and label of every rebalance tick; the label stands on the first only."""
    hit = series.where("rebalance = 1").select("t")
    return hit.select("t", F.when(F.row_number().over(Window.orderBy("t")) == 1, F.lit(label)).otherwise(F.lit("")).alias("label"))


def compare(runs: dict[str, DataFrame], metric: str) -> DataFrame | None:
    """t and the metric of each run side by side; None if no run has it."""
    out = None
    for name, df in runs.items():
        if metric in df.columns:
            own = df.select("t", F.col(metric).alias(f"{metric}_{name}"))
            out = own if out is None else out.join(own, "t", "full")
    return out


def sweep(groups: DataFrame, configs: DataFrame, by: tuple, run: Callable[[pd.DataFrame, dict], dict], result: str) -> DataFrame:
    """by..., the columns of the configs, those of `result`, and error: one run for each group and each row of configs.

    run(rows of a group, configuration) gives a row of `result`. A run that raises becomes a row with its error and nulls,
    so it costs no other run. configs are few; a group of `by` and a configuration make one task's work.
    """
    names = configs.columns
    kinds = {f.name: f.dataType.simpleString() for f in [*groups.schema.fields, *configs.schema.fields]}
    fields = [x.split()[0].strip("`") for x in result.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        config = {c: pdf[c].iloc[0] for c in names}
        head = {c: pdf[c].iloc[0] for c in by} | config
        try:
            found = run(pdf.drop(columns=names), config) | {"error": None}
        except Exception as why:  # noqa: BLE001
            found = dict.fromkeys(fields) | {"error": f"{type(why).__name__}: {why}"}
        return pd.DataFrame([head | found])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (*by, *names)], result, "error string"])
    return groups.join(F.broadcast(configs), F.lit(True)).groupBy(*by, *names).applyInPandas(one, schema)
