"""Whole runs: a workload over ticks, a layout that adapts at rebalance ticks, and the time series of both.

Between two rebalances the layout is fixed, and the workload never looks at it. So the work of all ticks is one plan;
of it only the loads of the rebalance ticks (one row per key and rebalance) reach the driver, where the layouts of all
epochs follow from each other. The layouts, a table of slices by epoch, then meet the work of all ticks in one plan.

What a tick's row says of the layout: work, latency, fan-out and loads are under the layout before a rebalance of that
tick, imbalance, extremes of servers, utilisation and sizes under the one after it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import DIGITS, EPS, ratio, uniform
from ..operators import layout as layout_ops
from ..operators import metrics, planner, workload
from ..operators.rebalance import assign, balance, policy
from ..operators.routing import PRIMARY_BIAS, recent_work
from ..sources.shared import written


@dataclass(frozen=True)
class Config:
    """A run. Defaults are small; counts are of requests, not of objects, so large ones cost nothing more."""

    steps: int = 200
    n_servers: int = 8
    n_keys: int = 20
    nprobe: int = 20
    every: int = 50
    policy: str = "greedy"
    seed: int = 7
    requests_per_server: int = 10_000
    shards_min: int = 2
    shards_max: int = 5
    capacity: float = 1_000.0
    n_hot: int = 2
    hot_mass: float = 0.8
    hot_skew: float = 1.2
    burst_mean: float = 30.0
    burst_std: float = 10.0
    burst_min: int = 5
    burst_max: int = 60
    alt_probability: float = 0.3
    switch_probability: float = 0.01
    zipf_s: float = 1.1
    fixed_hot: tuple = ()
    churn_budget: float = 50.0
    max_moves: int = 10
    growth_frac: float = 0.02
    growth_add: float = 0.0
    growth_fraction: float = 0.02
    growth_k: int = 0
    growth_parts: int = 3
    split_hot: bool = True
    burn_in: int = 20
    window: int = 50
    fanout_samples: int = 16
    #: of requests; 0 or None: worked out from requests_per_server
    requests_mean: int = 0
    requests_std: int | None = None
    requests_min: int | None = None
    requests_max: int | None = None
    alt_n_hot: int | None = None
    alt_hot_mass: float | None = None
    start_mode: str = "zipf"
    #: one plan of a tick's requests together, or a plan for each request; whether a request may probe a key again
    aggregate: bool = True
    allow_repeat: bool = True
    #: one hot set for all requests of a tick, or one for each request (plans of single requests only)
    lock_payload: bool = True
    growth: bool = True
    #: after a rebalance, utilisation of servers without loads does not go back to the work before it
    reset_history: bool = True
    history: int = 200
    #: slices cut at random places in the order of keys, instead of shards of keys
    cuts: int = 0
    #: requests sampled for the demand that the min-max policy goes by; how near to the lower bound is enough for it
    demand_samples: int = 500
    gap: float = 0.01
    #: ticks between two states in a trace, 0 for none; states in the rows, too
    state_every: int = 1
    state_in_rows: bool = False

    def __post_init__(self):
        """Shares are clamped to 0 ... 1, lengths and counts to 1 and more."""
        within = {"hot_mass": (0.0, 1.0), "alt_probability": (0.0, 1.0), "switch_probability": (0.0, 1.0), "hot_skew": (0.0, None), "burst_mean": (1, None), "burst_std": (0, None), "burst_min": (1, None), "n_hot": (1, None), "nprobe": (1, None), "alt_hot_mass": (0.0, 1.0)}
        for name, (low, high) in within.items():
            value = getattr(self, name)
            if value is not None:
                value = max(low, value)
                object.__setattr__(self, name, value if high is None else min(high, value))
        if self.start_mode not in ("zipf", "uniform"):
            object.__setattr__(self, "start_mode", "zipf")

    def requests(self) -> tuple[int, int, int, int]:
        """Mean, deviation, least and greatest number of requests of a tick."""
        mean = self.requests_mean or max(1, self.n_servers * self.requests_per_server)
        std = round(mean * 0.2) if self.requests_std is None else self.requests_std
        low = max(1, mean - 3 * std) if self.requests_min is None else self.requests_min
        high = mean + 3 * std if self.requests_max is None else self.requests_max
        return mean, std, low, max(low, high)


def u(a: int, b: int) -> float:
    return int(hashlib.md5(f"{a}:{b}".encode()).hexdigest()[:DIGITS], 16) / 16**DIGITS


def _normal(a, b: int):
    """A repeatable standard normal column."""
    return F.sqrt(-2 * F.ln(uniform(a, F.lit(b)) * 0.999 + 0.0005)) * F.cos(2 * F.pi() * uniform(a, F.lit(b + 7)))


# ---- workload


def ticks(spark: SparkSession, c: Config) -> DataFrame:
    """t and what the requests of a tick are like."""
    base = spark.range(1, c.steps + 1).select(F.col("id").cast("int").alias("t"))
    long = lambda n: F.lit(int(n)).cast("long")
    requests = base.select("t", workload.volume(_normal(F.col("t"), c.seed), *map(long, c.requests())).alias("n_requests"))
    n_bursts = c.steps // max(1, c.burst_min) + 1
    bursts = spark.range(1, n_bursts + 1).select(F.col("id").cast("int").alias("burst_id"))
    bursts = bursts.withColumn("burst_len", workload.burst_length(_normal(F.col("burst_id"), c.seed + 1), c.burst_mean, c.burst_std, c.burst_min, c.burst_max))
    bursts = workload.burst_modes(bursts, uniform(F.col("burst_id"), F.lit(c.seed + 2)) < c.alt_probability)
    timeline = workload.burst_ticks(bursts).withColumn("t", F.col("t").cast("int")).where(F.col("t") <= c.steps).join(bursts.select("burst_id", "burst_mode"), "burst_id")
    modes = workload.distribution_modes(base.select("t", (uniform(F.col("t"), F.lit(c.seed + 3)) < c.switch_probability).cast("int").alias("dist_switch")), first=c.start_mode)
    mass = F.when(F.col("burst_mode") == "alt", F.lit(c.hot_mass if c.alt_hot_mass is None else c.alt_hot_mass)).otherwise(F.lit(c.hot_mass))
    return requests.join(timeline, "t").join(modes, "t").withColumn("hot_mass", mass)


def hot_sets(at: DataFrame, c: Config) -> DataFrame:
    """t, k, place, weight of the tick's hot keys."""
    n_hot = F.when(F.col("burst_mode") == "alt", F.lit(c.n_hot if c.alt_n_hot is None else c.alt_n_hot)).otherwise(F.lit(c.n_hot))
    bursts = at.select("burst_id", n_hot.alias("n_hot")).distinct()
    if c.fixed_hot:
        keyed = bursts.select("burst_id", F.posexplode(workload.fixed_hot(F.array(*map(F.lit, c.fixed_hot)), c.n_keys, c.n_hot)).alias("place", "k")).withColumn("place", F.col("place") + 1)
    else:
        keyed = bursts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(c.n_keys - 1))))
        place = F.row_number().over(Window.partitionBy("burst_id").orderBy(uniform(F.col("k"), F.col("burst_id") + c.seed), "k"))
        keyed = keyed.withColumn("place", place).where(F.col("place") <= F.col("n_hot")).drop("n_hot")
    return at.select("t", "burst_id").join(workload.hot_weights(keyed, c.hot_skew), "burst_id").select("t", "k", "place", "weight")


def key_sizes(c: Config) -> np.ndarray:
    return np.array([1 + 9 * u(k, c.seed + 4) for k in range(c.n_keys)])


def key_costs(c: Config) -> np.ndarray:
    return np.array([1 + 3 * u(k, c.seed + 5) for k in range(c.n_keys)])


# ---- layouts


def first_layout(c: Config) -> pd.DataFrame:
    """Shards of each key on one server; with cuts, as many runs of keys on a server each, in turn."""
    rows = []
    if c.cuts > 0:
        order = sorted(range(1, c.n_keys), key=lambda k: (u(k, c.seed + 11), k))[: c.cuts - 1]
        run = np.searchsorted(np.sort(order), np.arange(c.n_keys), side="right")
        out = pd.DataFrame({"slice_id": np.arange(1, c.n_keys + 1), "k": np.arange(c.n_keys), "size": key_sizes(c), "server": run % c.n_servers})
        return out.assign(load=0.0)
    for k, size in enumerate(key_sizes(c)):
        n = c.shards_min + int(u(k, c.seed + 6) * (c.shards_max - c.shards_min + 1))
        w = np.array([0.2 + u(k * 31 + p, c.seed + 8) for p in range(n)])
        rows += [(k, size * x / w.sum(), k % c.n_servers) for x in w]
    out = pd.DataFrame(rows, columns=["k", "size", "server"])
    out.insert(0, "slice_id", np.arange(1, len(out) + 1))
    return out.assign(load=0.0)


def _ordered(layout: pd.DataFrame) -> pd.DataFrame:
    return layout.sort_values(["k", "size", "slice_id"], ascending=[True, False, True])


def _with_loads(layout: pd.DataFrame, loads: np.ndarray) -> pd.DataFrame:
    w = layout["size"].clip(lower=EPS)
    return layout.assign(load=loads[layout["k"]] * w / w.groupby(layout["k"]).transform("sum"))


def _grow(c: Config, layout: pd.DataFrame, loads: np.ndarray, cursor: int) -> tuple[pd.DataFrame, list[dict], int]:
    live = [int(k) for k in np.lexsort((np.arange(len(loads)), -loads)) if loads[k] > 0]
    n = min(len(live), c.growth_k) if c.growth_k > 0 else min(len(live), max(1, round(len(live) * max(0.0, c.growth_fraction))))
    chosen, actions, next_id = live[:n], [], int(layout["slice_id"].max()) + 1
    total = sum(loads[k] for k in chosen)
    for k in chosen:
        pull = loads[k] / total * len(chosen) if total > EPS else 1.0
        before = float(layout.loc[layout["k"] == k, "size"].sum())
        added = before * c.growth_frac * (0.5 + pull) + c.growth_add * max(1.0, 0.5 + pull)
        if added <= 0:
            continue
        parts = min(c.growth_parts, 1 + round((c.growth_parts - 1) * min(1.0, pull)))
        w = np.array([0.2 + u(next_id + p, c.seed + 9) for p in range(parts)])
        for p, x in enumerate(w / w.sum()):
            actions.append({"kind": "add_hot_data", "cluster": k, "cluster_load": float(loads[k]), "cluster_load_share": float(loads[k] / total) if total > EPS else 0.0, "cluster_size_before": before, "cluster_size_after": before + float(added), "lo": k, "hi": k + 1, "slice_id": next_id, "server": cursor % c.n_servers, "delta": float(added * x), "part_index": p, "parts_for_cluster": parts})
            next_id, cursor = next_id + 1, cursor + 1
    new = pd.DataFrame([(a["slice_id"], a["cluster"], a["delta"], a["server"], 0.0) for a in actions], columns=layout.columns)
    return pd.concat([layout, new], ignore_index=True) if len(new) else layout, actions, cursor


def _split(c: Config, layout: pd.DataFrame, hot: list[int]) -> tuple[pd.DataFrame, list[dict]]:
    actions, next_id = [], int(layout["slice_id"].max()) + 1
    for k in hot:
        own = layout[layout["k"] == k].sort_values(["load", "size", "slice_id"], ascending=[False, False, True])
        if own.empty or own["size"].iloc[0] <= EPS:
            continue
        s = own.iloc[0]
        r = 0.3 + 0.4 * u(int(s["slice_id"]), c.seed + 10)
        halves = pd.DataFrame({"slice_id": [next_id, next_id + 1], "k": k, "size": [s["size"] * r, s["size"] * (1 - r)], "server": int(s["server"]), "load": [s["load"] * r, s["load"] * (1 - r)]})
        actions.append({"kind": "split_hot", "key": k, "parent_slice": int(s["slice_id"]), "server": int(s["server"]), "new_slices": [next_id, next_id + 1], "parent": _structs(own.iloc[:1])[0], "children": _structs(halves)})
        layout, next_id = pd.concat([layout[layout["slice_id"] != s["slice_id"]], halves], ignore_index=True), next_id + 2
    return layout, actions


def reassign(c: Config, layout: pd.DataFrame, popularity: np.ndarray) -> tuple[pd.DataFrame, list[dict]]:
    """A new layout and its moves. Greedy goes by the slices' loads; the min-max policy by the keys' demand (given as popularity).

    After the min-max policy each key is one slice, and loads are unknown until the next tick.
    """
    if policy(c.policy) == "greedy":
        layout = layout.sort_values("slice_id", ignore_index=True)
        moves = balance(*(layout[x].to_numpy() for x in ("slice_id", "size", "load", "server")), {s: c.capacity for s in range(c.n_servers)}, c.churn_budget)
        to = {m["slice_id"]: m["to"] for m in moves}
        key = dict(zip(layout["slice_id"], layout["k"].astype(int)))
        moves = [{"kind": "reassign", "cluster": key[m["slice_id"]], "lo": key[m["slice_id"]], "hi": key[m["slice_id"]] + 1, **m} for m in moves]
        return layout.assign(server=[to.get(s, v) for s, v in zip(layout["slice_id"], layout["server"])]), moves
    sizes = layout.groupby("k")["size"].sum().reindex(range(c.n_keys), fill_value=0.0)
    current = _ordered(layout).drop_duplicates("k").set_index("k")["server"].reindex(range(c.n_keys), fill_value=0)
    to = assign(sizes.to_numpy(), key_costs(c) * popularity, current.to_numpy().copy(), np.full(c.n_servers, c.capacity), c.max_moves, c.gap)
    return pd.DataFrame({"slice_id": np.arange(1, c.n_keys + 1), "k": np.arange(c.n_keys), "size": sizes.to_numpy(), "server": to, "load": 0.0}), []


def _structs(layout: pd.DataFrame) -> list[dict]:
    """Slices by id as they stand in states, differences and actions."""
    own = layout.sort_values("slice_id")
    return [{"slice_id": int(i), "lo": int(k), "hi": int(k) + 1, "cluster": int(k), "size": float(z), "load": float(x), "server": int(v)} for i, k, z, x, v in zip(*(own[c] for c in ("slice_id", "k", "size", "load", "server")))]


def state(layout: pd.DataFrame) -> dict:
    """A layout as in a trace: slices, and by key its first slice and server, its slices, their servers and sizes."""
    groups = [g for _, g in _ordered(layout).groupby("k")]
    lists = lambda column, kind: [[kind(x) for x in g[column]] for g in groups]
    ids, places = lists("slice_id", int), lists("server", int)
    return {"slices": _structs(layout), "key_to_slice": [x[0] for x in ids], "key_to_server": [x[0] for x in places], "cluster_to_slices": ids, "cluster_to_servers": places, "cluster_shard_sizes": lists("size", float)}


def _changes(before: pd.DataFrame, after: pd.DataFrame) -> dict[str, list]:
    """The five differences of two layouts, as diff.whole() has them."""
    a, b, old, new = state(before), state(after), before.set_index("slice_id"), after.set_index("slice_id")
    both = old.index.intersection(new.index).sort_values()
    shape = lambda x: {k: parts for k, parts in enumerate(zip(x["cluster_to_slices"], x["cluster_to_servers"], x["cluster_shard_sizes"]))}
    sa, sb = shape(a), shape(b)
    names = ("slices", "servers", "shard_sizes")
    return {
        "slice_added": [x for x in b["slices"] if x["slice_id"] not in old.index],
        "slice_removed": [x for x in a["slices"] if x["slice_id"] not in new.index],
        "slice_moved": [{"slice_id": int(i), "from": int(old.at[i, "server"]), "to": int(new.at[i, "server"])} for i in both if old.at[i, "server"] != new.at[i, "server"]],
        "key_migrations": [{"key": k, "from": x, "to": y} for k, (x, y) in enumerate(zip(a["key_to_server"], b["key_to_server"])) if x != y],
        "cluster_transitions": [{"cluster": k, **{f"{n}_{when}": x[i] for i, n in enumerate(names) for when, x in (("before", sa[k]), ("after", sb[k]))}} for k in sa if k in sb and sa[k] != sb[k]],
    }


def require_covered(c: Config, layout: pd.DataFrame, t: int) -> None:
    """Raises where a key has no slice, since its work would go nowhere."""
    if missing := sorted(set(range(c.n_keys)) - set(layout["k"])):
        raise KeyError(f"after tick {t}, keys without a slice: {missing[:5]}")


def adapt(c: Config, loads: dict[int, np.ndarray], hot: dict[int, list[int]], demand: dict[int, np.ndarray], reassign: Callable) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Layouts of all epochs, one event row per rebalance tick, and (t, server, load) after each. loads, hot, demand: by rebalance tick."""
    import json

    layout, cursor, layouts, events, left = first_layout(c), 0, [], [], []
    require_covered(c, layout, 0)
    layouts.append(layout.assign(epoch=0))
    for epoch, t in enumerate(sorted(loads), 1):
        before = _with_loads(layout, loads[t])
        grows = c.growth and (c.growth_frac > 0 or c.growth_add > 0)
        grown, growth_actions, cursor = _grow(c, before, loads[t], cursor) if grows else (before, [], cursor)
        cut, split_actions = _split(c, grown, hot.get(t, [])) if c.split_hot else (grown, [])
        layout, moves = reassign(c, cut, demand[t])
        require_covered(c, layout, t)
        diff = _changes(before, layout)
        left += [(t, s, float(layout.loc[layout["server"] == s, "load"].sum())) for s in range(c.n_servers)]
        counts = {"slice_added": "slice_added", "slice_removed": "slice_removed", "slice_moved": "slice_moved", "key_migrations": "key_migration", "cluster_transitions": "cluster_transition"}
        events.append(
            {
                "t": t,
                "growth_event": int(bool(growth_actions)),
                "growth_added_total": float(sum(a["delta"] for a in growth_actions)),
                "growth_slices": len(growth_actions),
                "growth_servers": json.dumps(sorted({a["server"] for a in growth_actions})),
                "growth_clusters": json.dumps(list(dict.fromkeys(a["cluster"] for a in growth_actions))),
                "growth_actions": json.dumps(growth_actions),
                "rebalance_actions": json.dumps(split_actions + moves),
                "rebalance_diff": json.dumps(diff),
                **{f"rebalance_{n}": json.dumps(x) for n, x in diff.items()},
                **{f"rebalance_{counts[n]}_count": len(x) for n, x in diff.items()},
                "state_before": json.dumps(state(before)),
                "state_after": json.dumps(state(layout)),
            }
        )
        layouts.append(layout.assign(epoch=epoch))
    return pd.concat(layouts, ignore_index=True), pd.DataFrame(events), pd.DataFrame(left, columns=["t", "server", "load"])


# ---- the run


@dataclass(frozen=True)
class Parts:
    """What a run is made of; each part can be replaced by another of the same signature."""

    ticks: Callable[[SparkSession, Config], DataFrame] = ticks
    hot_sets: Callable[[DataFrame, Config], DataFrame] = hot_sets
    plan: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame] = planner.plan_counts
    heat: Callable[[DataFrame], DataFrame] = metrics.heat
    reassign: Callable[[Config, pd.DataFrame, np.ndarray], tuple[pd.DataFrame, list[dict]]] = reassign


def _named(entries):
    """Keys of sorted entries as strings, as JSON has them."""
    return F.transform(entries, lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")))


@dataclass(frozen=True)
class Run:
    """A run: its series, and what a trace needs beside it."""

    config: Config
    series: DataFrame
    #: epoch, slice_id, k, size, server; t, slice_id, load; t, k, cnt
    slices: DataFrame
    loads: DataFrame
    counts: DataFrame
    #: a row per rebalance, with the states before and after
    events: pd.DataFrame
    first: dict

    def states(self) -> DataFrame:
        """t, state: the layout that a tick's work met, with the loads that it left, as JSON; every state_every ticks."""
        c = self.config
        at = self.series.where(F.col("t") % max(1, c.state_every) == 0) if c.state_every > 0 else self.series.limit(0)
        every = c.every if c.every > 0 else c.steps + 1
        own = at.select("t", F.floor((F.col("t") - 1) / every).alias("epoch")).join(self.slices, "epoch")
        own = own.select("t", "slice_id", F.col("k").alias("lo"), (F.col("k") + 1).alias("hi"), "size", "server")
        found = layout_ops.state(own, self.loads, ("t",))
        return found.select("t", F.to_json(F.struct(*[x for x in found.columns if x != "t"])).alias("state"))


def run(spark: SparkSession, c: Config, parts: Parts = Parts(), progress: Callable[[str], None] | None = None) -> DataFrame:
    """The time series: a row per tick, maps and sets as JSON."""
    return whole_run(spark, c, parts, progress).series


def _sampled(at: DataFrame, n, keys: DataFrame, hot: DataFrame, c: Config, repeat: bool) -> DataFrame:
    """t, request, k, cnt of requests 1 ... n (a column or a number) of each tick."""
    samples = at.select("t", F.explode(F.sequence(F.lit(1), n)).alias("request"), "hot_mass").withColumn("seed", F.col("t").cast("long") * STRIDE + F.col("request"))
    return planner.request_plans(samples, keys, hot, min(c.nprobe, c.n_keys), repeat=repeat)


#: Requests of a tick that can have a hot set of their own.
STRIDE = 1 << 24


def whole_run(spark: SparkSession, c: Config, parts: Parts = Parts(), progress: Callable[[str], None] | None = None) -> Run:
    say = progress or (lambda text: None)
    at = written(parts.ticks(spark, c).coalesce(1))
    hot = written(parts.hot_sets(at, c).coalesce(1))
    keys = workload.zipf(spark, c.n_keys, c.zipf_s, c.seed)
    keys = written(keys.coalesce(1))
    say(f"workload of {c.steps} ticks")
    if c.aggregate:
        counts = written(parts.plan(at, keys, hot, c.nprobe))
    else:
        plans = written(_request_plans(at, keys, hot, c, parts))
        counts = plans.groupBy("t", "k").agg(F.sum("cnt").alias("cnt"))
    costs = spark.createDataFrame([(k, float(x)) for k, x in enumerate(key_costs(c))], "k int, cost double")
    work = planner.cost_of(counts, costs)
    loads: dict[int, np.ndarray] = {t: np.zeros(c.n_keys) for t in range(c.every, c.steps + 1, c.every)} if c.every > 0 else {}
    if loads:  # a row per key and rebalance
        for r in work.where(F.col("t") % c.every == 0).collect():
            loads[r["t"]][r["k"]] += r["cost"]
    popularity = np.array([r["prob"] for r in keys.orderBy("k").collect()])
    hot_lists = {t: [] for t in loads}
    for r in hot.where(F.col("t") % max(1, c.every) == 0).orderBy("t", "place").collect() if loads else []:
        hot_lists[r["t"]].append(r["k"])
    demand = {t: popularity for t in loads}
    if loads and policy(c.policy) != "greedy" and c.demand_samples > 0:  # what sampled requests of the tick would probe
        sampled = _sampled(at.where(F.col("t") % c.every == 0), F.lit(c.demand_samples), keys, hot, c, True)
        demand = {t: np.zeros(c.n_keys) for t in loads}
        for r in sampled.groupBy("t", "k").agg(F.sum("cnt").alias("cnt")).collect():
            demand[r["t"]][r["k"]] = r["cnt"] / c.demand_samples
    say(f"layouts of {len(loads)} rebalances")
    layouts, events, left = adapt(c, loads, hot_lists, demand, parts.reassign)
    say("series")
    slices = spark.createDataFrame(layouts[["epoch", "slice_id", "k", "size", "server"]].astype({"epoch": "int64", "slice_id": "int64", "k": "int32", "size": "float64", "server": "int32"}))
    every = c.every if c.every > 0 else c.steps + 1
    before, after = F.floor((F.col("t") - 1) / every), F.floor(F.col("t") / every)

    own = Window.partitionBy("epoch", "k")
    shares = slices.withColumn("share", F.col("size") / F.sum("size").over(own)).select("epoch", "k", "slice_id", "server", "share")
    work = written(work)
    alloc = written(work.withColumn("epoch", before).join(shares, ["epoch", "k"]).select("t", "k", "slice_id", "server", (F.col("cost") * F.col("share")).alias("load")))
    first = layouts[layouts["epoch"] == 0]
    primary = spark.createDataFrame([(int(k), int(s)) for k, s in _ordered(first).drop_duplicates("k")[["k", "server"]].to_numpy()], "k int, server int")
    routed = alloc.select("t", "server", F.col("load").alias("work")).unionByName(work.join(primary, "k").select("t", "server", (F.col("cost") * PRIMARY_BIAS).alias("work"))).groupBy("t", "server").agg(F.sum("work").alias("work"))
    grid = at.select("t").withColumn("server", F.explode(F.sequence(F.lit(0), F.lit(c.n_servers - 1))))
    per = grid.join(routed, ["t", "server"], "left").withColumn("reached", F.col("work").isNotNull()).na.fill(0.0, ["work"])
    heat = parts.heat(per.select("t", "server", "work")).select("t", "server", "latency", "heat")
    if not c.aggregate:  # a request finds the heat that those before it in the tick have left
        places = shares.groupBy("epoch", "k", "server").agg(F.sum("share").alias("w"))
        epochs = slices.select("epoch").distinct()
        places = places.unionByName(epochs.join(F.broadcast(primary.withColumn("w", F.lit(PRIMARY_BIAS))), F.lit(True)).select("epoch", "k", "server", "w")).groupBy("epoch", "k", "server").agg(F.sum("w").alias("w"))
        asked = plans.join(F.broadcast(costs), "k").withColumn("epoch", before).join(places, ["epoch", "k"])
        asked = written(asked.groupBy("t", "request", "server").agg(F.sum(F.col("cnt") * F.col("cost") * F.col("w")).alias("work")))
        slow = metrics.request_latency(asked).groupBy("t", "server").agg(F.sum("latency").alias("slow"))
        heat = heat.join(slow, ["t", "server"], "left").select("t", "server", F.coalesce("slow", "latency").alias("latency"), "heat")
    # on a rebalance tick, loads are those that the event left: new shards have none yet, split ones share
    moved = alloc.where(before == after).groupBy("t", "server").agg(F.sum("load").alias("load"))
    if len(left):
        moved = moved.unionByName(spark.createDataFrame(left.astype({"t": "int32", "server": "int32"})))
    held = slices.groupBy("epoch", "server").agg(F.sum("size").alias("keyspace"), F.count(F.lit(1)).cast("int").alias("slicecount"))
    per = per.join(heat, ["t", "server"]).join(moved, ["t", "server"], "left").na.fill(0.0, ["load"]).withColumn("util", F.col("load") / c.capacity)
    per = per.withColumn("epoch", after).join(held, ["epoch", "server"], "left").na.fill(0.0, ["keyspace"]).na.fill(0, ["slicecount"])
    if not c.reset_history:  # servers without any load at all go by their recent work
        recent = recent_work(per.select("t", "server", "work"), c.history)
        total = F.sum("load").over(Window.partitionBy("t"))
        per = per.withColumn("total", total).join(recent, ["t", "server"])
        per = per.withColumn("util", F.when(F.col("total") > EPS, F.col("util")).otherwise(F.col("recent") / c.capacity)).drop("total", "recent")
    per = written(per)

    names = {"slicecount": "server_slice_counts"}

    def cells(value: str):
        return F.to_json(F.map_from_entries(_named(F.array_sort(F.collect_list(F.struct(F.col("server").alias("key"), F.col(value).alias("value"))))))).alias(names.get(value, f"server_{value}_map"))

    top = lambda v: -F.max(F.struct(F.col(v), (-F.col("server")).alias("s")))["s"]
    low = lambda v: F.min(F.struct(F.col(v), F.col("server").alias("s")))["s"]
    ends = [(top("util"), "hottest_server"), (low("util"), "coldest_server"), (top("work"), "hottest_work_server"), (low("work"), "coldest_work_server")]
    series = per.groupBy("t").agg(
        F.sum("latency").alias("latency"),
        F.sum(F.col("reached").cast("int")).cast("double").alias("fanout"),
        ratio(F.max("util"), F.avg("util")).alias("imbalance"),
        ratio(F.max("work"), F.avg("work")).alias("work_imbalance"),
        *[x.cast("int").alias(n) for x, n in ends],
        F.max("work").alias("hottest_work"),
        F.min("work").alias("coldest_work"),
        F.avg("work").alias("mean_work"),
        F.sum("work").alias("workload"),
        F.sum("slicecount").cast("int").alias("n_slices_total"),
        *[cells(v) for v in ("work", "heat", "util", "keyspace", "slicecount")],
    )
    in_order = Window.orderBy("t")
    series = series.withColumn("imbalance_pre", F.coalesce(F.lag("imbalance").over(in_order), "work_imbalance")).drop("work_imbalance")
    if not c.aggregate:  # servers that a request reaches, its keys' primaries too, on average
        series = series.drop("fanout").join(asked.groupBy("t", "request").count().groupBy("t").agg(F.avg("count").alias("fanout")), "t")
        probes = plans.withColumn("epoch", before)
    elif c.fanout_samples > 0:
        probes = _sampled(at, F.least(F.lit(c.fanout_samples), F.col("n_requests").cast("int")), keys, hot, c, c.allow_repeat).withColumn("epoch", before)
    else:
        probes = counts.withColumn("request", F.lit(0)).withColumn("epoch", before).limit(0)
    fans = probes.join(slices.select("epoch", "k", "server").distinct(), ["epoch", "k"]).groupBy("t", "request").agg(F.countDistinct("server").cast("double").alias("fanout"))
    stats = metrics.fanout_stats(fans, series.select("t", "fanout"))
    per_slice = alloc.groupBy("t", "slice_id").agg(F.sum("load").alias("load"))
    slice_ends = metrics.extremes(per_slice, "slice_id", "load", "hottest_slice", "coldest_slice")
    slice_ends = slice_ends.withColumnRenamed("hottest_slice_value", "hottest_slice_load").withColumnRenamed("coldest_slice_value", "coldest_slice_load")
    as_json = lambda key, value, name: F.to_json(F.map_from_entries(_named(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))))).alias(name)
    maps = work.groupBy("t").agg(as_json("k", "cost", "cluster_loads")).join(per_slice.groupBy("t").agg(as_json("slice_id", "load", "slice_loads")), "t")
    sets = hot.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("place", "k", "weight"))).alias("h")).select("t", F.to_json("h.k").alias("hot_set"), F.to_json("h.weight").alias("hot_weights"))
    out = series.join(metrics.hot_ratio(counts, hot), "t").join(stats, "t", "left").join(slice_ends, "t", "left").join(maps, "t", "left").join(sets, "t", "left").join(at, "t")
    if len(events):
        shown = events.drop(columns=["state_before", "state_after"])
        out = out.join(spark.createDataFrame(shown), "t", "left")
        texts = [x for x in shown.columns if isinstance(shown[x].iloc[0], str)]
        zero = {x: 0 for x in shown.columns if x not in ("t", "growth_added_total", *texts)}
        out = out.na.fill(zero).na.fill({"growth_added_total": 0.0, "rebalance_diff": "{}"}).na.fill("[]", [x for x in texts if x != "rebalance_diff"])
    out = out.withColumn("rebalance", (F.col("t") % every == 0).cast("int")).withColumn("burn_in", (F.col("t") <= c.burn_in).cast("int")).withColumn("n_clusters_total", F.lit(c.n_keys))
    out = out.withColumn("fanout_var", metrics.rolling_variance(out, "fanout", c.window, c.burn_in))
    # a column for each server and measure, in one aggregation
    one = lambda name, s: F.max(F.when(F.col("server") == s, F.col(name)))
    measures = {"work": "work", "keyspace": "keyspace", "heat": "heat", "util": "util", "slicecount": "slicecount"}
    wide = per.groupBy("t").agg(*[one(column, s).alias(f"{m}_s{s}") for s in range(c.n_servers) for m, column in measures.items()])
    out = out.join(wide, "t")
    found = Run(c, out, slices, per_slice, counts, events, state(first))
    if c.state_in_rows:
        lists = layout_lists(found)
        found = replace(found, series=out.join(lists, "t", "left"))
    return found


def _request_plans(at: DataFrame, keys: DataFrame, hot: DataFrame, c: Config, parts: Parts) -> DataFrame:
    """t, request, k, cnt of every request; with a payload of its own, a request's hot keys are those of its own burst."""
    if c.lock_payload:
        return _sampled(at, F.col("n_requests").cast("int"), keys, hot, c, c.allow_repeat)
    each = at.withColumn("request", F.explode(F.sequence(F.lit(1), F.col("n_requests").cast("int"))))
    # requests pass through bursts as ticks do, burst_mean requests in each
    each = each.withColumn("burst_id", F.col("burst_id") * STRIDE + F.floor((F.col("request") - 1) / max(1, int(c.burst_mean))))
    each = written(each.withColumn("tick", F.col("t")).withColumn("t", F.col("t").cast("long") * STRIDE + F.col("request")))
    own = parts.hot_sets(each, c)
    samples = each.select("t", "request", "hot_mass", (F.col("tick").cast("long") * STRIDE + F.col("request")).alias("seed"))
    plans = planner.request_plans(samples, keys, own, min(c.nprobe, c.n_keys), repeat=c.allow_repeat)
    return plans.withColumn("t", F.floor(F.col("t") / STRIDE).cast("int"))


def layout_lists(found: Run) -> DataFrame:
    """t and a state_ column of JSON for each part of a tick's state."""
    names = ("key_to_slice", "key_to_server", "cluster_to_slices", "cluster_to_servers", "cluster_shard_sizes", "slices")
    return found.states().select("t", *[F.get_json_object("state", f"$.{n}").alias(f"state_{n}") for n in names])




def trace_of(found: Run) -> list[DataFrame]:
    """Events of a run for trace.write_trace: the first state, then per tick step, growth and rebalance.

    A step has the layout's state every state_every ticks, a rebalance the states before and after it and what differs.
    """
    import json

    from ..sources.trace import event, raw

    series, spark = found.series, found.series.sparkSession
    skip = ("growth_", "rebalance", "state_", "work_s", "keyspace_s", "heat_s", "util_s", "slicecount_s")
    steps = [x for x in series.columns if not x.startswith(skip)]
    numbers = found.counts.groupBy("t").agg(F.to_json(F.map_from_entries(_named(F.array_sort(F.collect_list(F.struct(F.col("k").alias("key"), F.col("cnt").alias("value"))))))).alias("plan_counts"))
    rows = series.select(*steps).join(numbers, "t", "left").join(found.states(), "t", "left")
    nested = [x for x in rows.columns if x in ("state", "plan_counts", "hot_set", "hot_weights", "cluster_loads", "slice_loads") or x.endswith(("_map", "server_slice_counts"))]
    step = raw(event("step", *[x for x in rows.columns if x not in nested]), nested)
    first = {"type": "state", "t": 0, "reason": "init", "state": found.first}
    lines = [(0, 0, json.dumps(first))]
    for e in found.events.to_dict("records"):
        t, parsed = int(e["t"]), lambda name: json.loads(e[name])  # noqa: B023
        if e["growth_event"]:
            lines.append((t, 2, json.dumps({"type": "growth", "t": t, "mode": "popular_round_robin", "clusters": parsed("growth_clusters"), "servers": parsed("growth_servers"), "actions": parsed("growth_actions"), "total_added": e["growth_added_total"]})))
        diff = parsed("rebalance_diff")
        lines.append((t, 3, json.dumps({"type": "rebalance", "t": t, "policy": found.config.policy, "actions": parsed("rebalance_actions"), "state_before": parsed("state_before"), "state_after": parsed("state_after"), "diff": diff, "cluster_migrations": diff["key_migrations"], "cluster_transitions": diff["cluster_transitions"]})))
    return [rows.select("t", F.lit(1).alias("place"), step.alias("line")), spark.createDataFrame(lines, "t int, place int, line string")]


def summary(series: DataFrame) -> DataFrame:
    """avg_latency, p95_latency and the last imbalance of a run."""
    last = series.agg(F.avg("latency").alias("avg_latency"), F.max_by("imbalance", "t").alias("imbalance"))
    return metrics.p95(series, "latency").join(F.broadcast(last), F.lit(True))


# ---- sweeps: many small runs, one per task

SWEEP = "name string, config string, replicate int, avg_latency double, p95_latency double, imbalance double, hottest_server int, max_server_heat double, error string"


def _small_run(c: Config, keep_loads: bool = True) -> dict:
    """A run in one process, for sweeps: a query of nprobe distinct keys per tick, no growth and no splits.

    keep_loads: a rebalance goes by the loads that the tick's query left on the slices. Without, slices have no loads then,
    so that it finds nothing to move.
    """
    policy(c.policy)
    layout, cap = first_layout(c), {s: c.capacity for s in range(c.n_servers)}
    rank = np.empty(c.n_keys, int)
    rank[sorted(range(c.n_keys), key=lambda k: (u(k, c.seed), k))] = np.arange(c.n_keys)
    p, rng = 1 / (1 + rank) ** c.zipf_s, np.random.default_rng(c.seed)
    p /= p.sum()
    costs = 1 + 3 * p * c.n_keys
    primary = _ordered(layout).drop_duplicates("k").set_index("k")["server"].to_numpy()
    heat, latency, n = np.zeros(c.n_servers), [], min(c.nprobe, c.n_keys)
    hot, until = np.empty(0, int), 0
    for t in range(1, c.steps + 1):
        if t > until:  # a new burst
            until = t - 1 + int(np.clip(round(rng.normal(c.burst_mean, c.burst_std)), c.burst_min, c.burst_max))
            hot = rng.choice(c.n_keys, min(c.n_hot, c.n_keys), replace=False)
        # weighted draws without replacement, of the hot keys and of the others: the least exponential keys
        to_hot = min(len(hot), round(c.hot_mass * n))
        key = rng.exponential(size=c.n_keys) / p
        cold = key.copy()
        cold[hot] = np.inf
        near = rng.exponential(size=len(hot)) * (1 + np.arange(len(hot))) ** c.hot_skew
        probed = np.r_[hot[np.argsort(near)[:to_hot]], np.argsort(cold)[: n - to_hot]]
        loads = np.zeros(c.n_keys)
        loads[probed] = costs[probed]
        now = _with_loads(layout, loads)
        work = np.bincount(now["server"], weights=now["load"], minlength=c.n_servers) + PRIMARY_BIAS * np.bincount(primary, weights=loads, minlength=c.n_servers)
        latency.append(float((work * (1 + metrics.ALPHA * heat)).sum()))
        heat = (heat + metrics.BETA * work) * (1 - metrics.DECAY)
        layout = now if keep_loads else layout.assign(load=0.0)
        if c.every > 0 and t % c.every == 0:
            layout, _ = reassign(c, layout, p)
            layout = _with_loads(layout, loads) if keep_loads else layout
    layout = _with_loads(layout, loads)
    util = np.bincount(layout["server"], weights=layout["load"], minlength=c.n_servers) / np.array([cap[s] for s in range(c.n_servers)])
    ranked = sorted(latency)
    return {"avg_latency": float(np.mean(latency)), "p95_latency": ranked[int(0.95 * (len(ranked) - 1))], "imbalance": float(util.max() / util.mean()) if util.mean() > EPS else 0.0, "hottest_server": int(heat.argmax()), "max_server_heat": float(heat.max())}


#: The sweep's base, and what is varied of it one at a time (fixed values).
SWEEP_BASE = {"n_keys": 512, "nprobe": 6, "n_servers": 32, "every": 50, "steps": 2000, "churn_budget": 5.0, "max_moves": 3, "capacity": 1000.0, "zipf_s": 1.2, "cuts": 32, "n_hot": 2, "hot_mass": 0.8, "burst_mean": 200.0, "burst_std": 50.0, "burst_min": 20, "burst_max": 800, "gap": 0.05, "seed": 42}
SWEEP_VARIED = {"n_servers": (8, 16, 32, 64, 128, 256), "every": (10, 25, 50, 100, 250, 500, 1000), "steps": (500, 1000, 2000, 4000, 8000, 16000)}


def grid() -> dict[str, Config]:
    """The 19 configurations of the full sweep; with three replicates 57 runs."""
    return {f"{field}-{x}": Config(**{**SWEEP_BASE, field: x}) for field, values in SWEEP_VARIED.items() for x in values}


def sweep(spark: SparkSession, configs: dict[str, Config], replicates: int = 3, keep_loads: bool = True) -> DataFrame:
    """A row for each configuration and replicate (seeds count up); what fails gives a row with its error."""
    import json
    from dataclasses import asdict

    names = list(configs)
    jobs = spark.createDataFrame([(n, r) for n in names for r in range(replicates)], "name string, replicate int").repartition(len(names) * replicates, "name", "replicate")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, r in zip(pdf["name"], pdf["replicate"]):
            c = configs[name]
            row = {"name": name, "config": json.dumps(asdict(c), sort_keys=True), "replicate": int(r), "avg_latency": math.nan, "p95_latency": math.nan, "imbalance": math.nan, "hottest_server": -1, "max_server_heat": math.nan, "error": None}
            try:
                row |= _small_run(replace(c, seed=c.seed + int(r)), keep_loads)
            except Exception as e:  # a failed run is a result of a sweep
                row["error"] = f"{type(e).__name__}: {e}"
            rows.append(row)
        return pd.DataFrame(rows)

    return jobs.groupBy("name", "replicate").applyInPandas(work, SWEEP)
