"""Rebalancing: moves of slices from the hottest to the coldest server within a churn budget, and a min-max assignment.

Scoring is a DataFrame operator. Choosing moves one after another is sequential by nature and works on a layout, not
on the workload: it runs per scenario on executors, with candidates scored by vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EPS


def candidates(slices: DataFrame, servers: DataFrame) -> DataFrame:
    """Moves from the hottest to the coldest server that lower the imbalance: slice_id, from, to, churn, before, after, weight.

    slices: slice_id, size, load, server; servers: server, capacity. weight is the gain per churn.
    """
    loads = servers.join(slices.groupBy("server").agg(F.sum("load").alias("load")), "server", "left")
    utils = loads.withColumn("load", F.coalesce("load", F.lit(0.0))).withColumn("cap", F.greatest(F.lit(EPS), F.col("capacity")))
    utils = utils.withColumn("util", F.when(F.col("capacity") > EPS, F.col("load") / F.col("capacity")).otherwise(0.0))
    everyone = Window.partitionBy()  # one row per server
    hot = F.max(F.struct("util", (-F.col("server")).alias("s"), "load", "cap")).over(everyone)
    cold = F.min(F.struct("util", F.col("server").alias("s"), "load", "cap")).over(everyone)
    utils = utils.withColumn("hot", hot).withColumn("cold", cold)
    rest = (F.col("server") != -F.col("hot.s")) & (F.col("server") != F.col("cold.s"))
    state = utils.agg(F.first("hot").alias("hot"), F.first("cold").alias("cold"), F.coalesce(F.max(F.when(rest, F.col("util"))), F.lit(0.0)).alias("rest"), F.sum("util").alias("total"), F.count(F.lit(1)).alias("n"))
    state = state.where("-hot.s <> cold.s AND total > 0").withColumn("before", F.col("hot.util") / (F.col("total") / F.col("n")))
    moves = slices.where("size > 0 AND load > 0").join(F.broadcast(state), F.col("server") == -F.col("hot.s"))
    a, b = F.greatest(F.lit(0.0), F.col("hot.load") - F.col("load")) / F.col("hot.cap"), (F.col("cold.load") + F.col("load")) / F.col("cold.cap")
    mean = (F.col("total") - F.col("load") / F.col("hot.cap") + F.col("load") / F.col("cold.cap")) / F.col("n")
    moves = moves.withColumn("after", F.when(mean > EPS, F.greatest(F.col("rest"), a, b) / mean))
    moves = moves.where("after < before").withColumn("weight", (F.col("before") - F.col("after")) / F.col("size"))
    return moves.select("slice_id", F.col("server").alias("from"), F.col("cold.s").alias("to"), F.col("size").alias("churn"), "before", "after", "weight")


def best_move(slices: DataFrame, servers: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.orderBy(F.col("weight").desc(), "slice_id"))
    return candidates(slices, servers).withColumn("nth", nth).where("nth = 1").drop("nth")


def balance(ids: np.ndarray, size: np.ndarray, load: np.ndarray, server: np.ndarray, capacity: dict[int, float], budget: float) -> list[dict]:
    """The moves of a rebalance, in order. It ends at the first best move that the budget does not hold."""
    sids = np.array(sorted(capacity))
    cap = np.array([capacity[s] for s in sids], float)
    at = np.searchsorted(sids, server)
    work = np.bincount(at, weights=load, minlength=len(sids))
    used, moves = 0.0, []
    while used < budget:
        util = np.where(cap > EPS, work / np.maximum(cap, EPS), 0.0)
        hot, cold = int(util.argmax()), int(util.argmin())
        if hot == cold or util.mean() <= EPS:
            break
        now = util[hot] / util.mean()
        others = np.delete(util, [hot, cold])
        rows = np.flatnonzero((at == hot) & (size > 0) & (load > 0))
        hot_cap, cold_cap = max(EPS, cap[hot]), max(EPS, cap[cold])
        peak = np.maximum(np.maximum(work[hot] - load[rows], 0) / hot_cap, (work[cold] + load[rows]) / cold_cap)
        peak = np.maximum(peak, others.max(initial=0.0))
        mean = (util.sum() - load[rows] / hot_cap + load[rows] / cold_cap) / len(sids)
        gain = np.where(mean > EPS, now - peak / np.maximum(mean, EPS), 0.0) / size[rows]
        if not len(rows) or gain.max() <= 0:
            break
        row = rows[int(gain.argmax())]
        if used + size[row] > budget:
            break
        used += size[row]
        at[row] = cold
        work = np.bincount(at, weights=load, minlength=len(sids))
        util = np.where(cap > EPS, work / np.maximum(cap, EPS), 0.0)
        moves.append({"step": len(moves) + 1, "slice_id": int(ids[row]), "from": int(sids[hot]), "to": int(sids[cold]), "churn": float(size[row]), "imbalance_before": float(now), "imbalance_after": float(util.max() / util.mean()) if util.mean() > EPS else 0.0})
    return moves


MOVES = "scenario long, step int, slice_id long, `from` int, `to` int, churn double, imbalance_before double, imbalance_after double"


def greedy(slices: DataFrame, capacity: dict[int, float], budget: float) -> DataFrame:
    """The action log of each scenario. slices: scenario, slice_id, size, load, server."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice_id")
        moves = balance(pdf["slice_id"].to_numpy(), pdf["size"].to_numpy(float), pdf["load"].to_numpy(float), pdf["server"].to_numpy(), capacity, budget)
        columns = ["step", "slice_id", "from", "to", "churn", "imbalance_before", "imbalance_after"]
        return pd.DataFrame(moves, columns=columns).assign(scenario=int(pdf["scenario"].iloc[0]))[["scenario", *columns]]

    return slices.groupBy("scenario").applyInPandas(run, MOVES)


#: One move of each scenario a step: the state is a row of arrays, the slices in the order of their ids.
_RECURSIVE = """
WITH RECURSIVE run (scenario, step, ids, size, load, srv, used, slice_id, `from`, `to`, churn, imbalance_before, imbalance_after) AS (
  SELECT scenario, 0, ids, size, load, srv, 0D, CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {start}
  UNION ALL
  SELECT scenario, step + 1, ids, size, load, next_srv, used + size[best], ids[best], sids[hot], sids[cold], size[best], util[hot] / mean,
    array_max({util_next}) / ({total_next} / n)
  FROM (SELECT *, transform(srv, (v, i) -> if(i = best, sids[cold], v)) AS next_srv FROM (
    SELECT *, CAST(array_position(gains, array_max(gains)) - 1 AS INT) AS best FROM (
      SELECT *, transform(srv, (v, i) -> if(v = sids[hot] AND size[i] > 0 AND load[i] > 0,
        (util[hot] / mean - greatest(greatest(work[hot] - load[i], 0D) / caps[hot], (work[cold] + load[i]) / caps[cold], rest) / ((total - load[i] / caps[hot] + load[i] / caps[cold]) / n)) / size[i], CAST('-Infinity' AS DOUBLE))) AS gains
      FROM (SELECT *, total / n AS mean, coalesce(array_max(filter(util, (u, j) -> j <> hot AND j <> cold)), 0D) AS rest FROM (
        SELECT *, aggregate(util, 0D, (a, u) -> a + u) AS total, CAST(array_position(util, array_max(util)) - 1 AS INT) AS hot, CAST(array_position(util, array_min(util)) - 1 AS INT) AS cold FROM (
          SELECT *, zip_with(work, caps, (w, c) -> w / c) AS util FROM (
            SELECT *, {sids} AS sids, {caps} AS caps, {n} AS n, transform({sids}, s -> {held}) AS work FROM run)))
        WHERE hot <> cold AND total > 1e-12)))
    WHERE gains[best] > 0 AND used < {budget} AND used + size[best] <= {budget}))
SELECT scenario, step, slice_id, `from`, `to`, churn, imbalance_before, imbalance_after FROM run WHERE step > 0
"""


def greedy_recursive(slices: DataFrame, capacity: dict[int, float], budget: float) -> DataFrame:
    """greedy() as one recursive query, without Python. Capacities are positive.

    A scenario moves as long as a move is worth it, but Spark ends recursions that go deeper than
    spark.sql.cteRecursionLevelLimit with an error.
    """
    entry = F.array_sort(F.collect_list(F.struct("slice_id", "size", "load", "server"))).alias("s")
    start = slices.groupBy("scenario").agg(entry).select("scenario", F.col("s.slice_id").alias("ids"), F.col("s.size").alias("size"), F.col("s.load").alias("load"), F.col("s.server").alias("srv"))
    sids = sorted(capacity)
    held = lambda srv: f"aggregate(zip_with({srv}, load, (v, l) -> if(v = s, l, 0D)), 0D, (a, x) -> a + x)"
    listed = f"array({', '.join(f'CAST({s} AS INT)' for s in sids)})"
    caps = f"array({', '.join(f'{max(EPS, capacity[s])!r}D' for s in sids)})"
    util_next = f"zip_with(transform(sids, s -> {held('next_srv')}), caps, (w, c) -> w / c)"
    text = _RECURSIVE.format(start="{start}", sids=listed, caps=caps, n=f"{len(sids)}D", held=held("srv"), util_next=util_next, total_next=f"aggregate({util_next}, 0D, (a, u) -> a + u)", budget=f"{budget!r}D")
    return slices.sparkSession.sql(text, start=start)


def lower_bound(load: np.ndarray, n_servers: int, current: np.ndarray | None = None, max_moves: int | None = None) -> float:
    """No assignment has a lower peak: the largest key, the mean of the servers and, with at most max_moves moves, what they leave.

    A server that loses m keys keeps at least what is left without its m largest ones. So a peak of z needs a move for
    each such remainder above z, over all servers: the (max_moves + 1)-th largest remainder bounds the peak.
    """
    least = float(max(load.max(initial=0.0), load.sum() / n_servers))
    if current is None or max_moves is None or not len(load):
        return least
    order = np.lexsort((-load, current))
    at, own = current[order], load[order]
    total = np.bincount(current, weights=load, minlength=n_servers)
    gone = np.cumsum(own)
    first = np.r_[True, at[1:] != at[:-1]]
    gone -= np.repeat((gone - own)[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
    rest = np.r_[total, total[at] - gone]
    return max(least, float(np.partition(rest, len(rest) - 1 - max_moves)[len(rest) - 1 - max_moves])) if max_moves < len(rest) else least


def assign(size: np.ndarray, load: np.ndarray, current: np.ndarray, capacity: np.ndarray, max_moves: int, gap: float = 0.0) -> np.ndarray:
    """Servers of keys with a low greatest load, within capacities and at most max_moves moves from the current ones.

    Servers over capacity are relieved first; where the moves do not suffice, there is no assignment and it raises. Then
    descent over single moves and swaps, until the peak is within `gap` of lower_bound() or nothing is better; for at
    most EXACT keys the optimum by branch and bound.
    """
    if len(size) != len(load) or len(size) != len(current):
        raise ValueError("sizes, loads and servers differ in length")
    if len(current) and (current.min() < 0 or current.max() >= len(capacity)):
        raise ValueError("a current server is out of range")
    start = _relieved(size, load, current, capacity, max_moves)
    if 0 < len(size) <= EXACT:
        return _exact(size, load, current, capacity, max_moves, start)
    return _descend(size, load, current, capacity, max_moves, start, gap)


def _relieved(size, load, current, capacity, max_moves):
    """Servers of keys after keys have left full servers for those with room: few and small moves first, then low loads."""
    now = current.copy()
    work, held = (np.bincount(now, weights=x, minlength=len(capacity)) for x in (load, size))
    for _ in range(len(size) + 1):
        excess = held - capacity
        full = int(excess.argmax()) if len(excess) else 0
        if not len(excess) or excess[full] <= EPS:
            break
        own = np.flatnonzero(now == full)
        room = held[None, :] + size[own][:, None] <= capacity[None, :] + EPS
        if not room.any():
            raise ValueError("no feasible assignment known: a server is over capacity and its keys fit nowhere")
        # a key that is enough by itself, the smallest of them; else the largest
        enough = size[own] >= excess[full] - EPS
        cost = np.where(enough, size[own], 2 * size.max() + 1 - size[own])
        i, j = np.unravel_index(np.where(room, cost[:, None] * (work.max() + 1) * 4 + work[None, :], np.inf).argmin(), room.shape)
        k = own[i]
        now[k] = j
        for x, values in ((work, load), (held, size)):
            x[full] -= values[k]
            x[j] += values[k]
    if (held > capacity + EPS).any() or (now != current).sum() > max_moves:
        raise ValueError("no feasible assignment known: the moves do not suffice to hold the capacities")
    return now


#: Servers that are looked at together, the least loaded first, and a server's keys of the load that suits best.
NEAR, CLOSE = 16, 8


def _descend(size, load, current, capacity, max_moves, start, gap=0.0):
    """Each step takes the best move or swap of the fullest server with the NEAR least loaded ones; with the next ones if none helps.

    Of a server's keys only the CLOSE ones whose load evens the two servers out best are tried for a swap, so a step
    needs keys of one server x NEAR x CLOSE cells.
    """
    now = start.copy()
    work, held = (np.bincount(now, weights=x, minlength=len(capacity)) for x in (load, size))
    enough = lower_bound(load, len(capacity), current, max_moves) * (1 + gap)
    spent = int((now != current).sum())
    members = [np.flatnonzero(now == s) for s in range(len(capacity))]
    members = [m[np.argsort(load[m], kind="stable")] for m in members]
    while True:
        top = int(work.argmax())
        if work[top] <= enough:
            return now
        own = members[top]
        others = np.argsort(work, kind="stable")
        others = others[others != top]
        best, choice = work[top] - 1e-9, None
        for at in range(0, len(others), NEAR):
            for c in others[at : at + NEAR].tolist():
                best, choice = _pair(size, load, current, capacity, max_moves, spent, work, held, own, members[c], top, c, best, choice)
            if choice is not None:
                break
        if choice is None:
            return now
        i, j, k = choice
        for key, source, to in ((i, top, j), *(((k, j, top),) if k is not None else ())):
            spent += int(to != current[key]) - int(source != current[key])
            now[key] = to
            for x, values in ((work, load), (held, size)):
                x[source] -= values[key]
                x[to] += values[key]
            members[source] = members[source][members[source] != key]
            members[to] = np.insert(members[to], np.searchsorted(load[members[to]], load[key]), key)


def _pair(size, load, current, capacity, max_moves, spent, work, held, own, theirs, top, c, best, choice):
    """The best move or swap between two servers, if it is better than what was found so far."""
    back = (current[own] == c).astype(int) - (current[own] == top)  # a key that goes home saves a move
    peak = np.maximum(work[top] - load[own], work[c] + load[own])
    peak = np.where((held[c] + size[own] > capacity[c] + EPS) | (spent - back > max_moves), np.inf, peak)
    if len(peak) and peak.min() < best:
        i = int(peak.argmin())
        best, choice = peak[i], (int(own[i]), c, None)
    if len(own) and len(theirs):
        near = np.searchsorted(load[theirs], load[own] - (work[top] - work[c]) / 2)[:, None] + np.arange(CLOSE)[None, :] - CLOSE // 2
        partner = theirs[np.clip(near, 0, len(theirs) - 1)]
        gain, grow = load[own][:, None] - load[partner], size[own][:, None] - size[partner]
        moved = spent - back[:, None] - (current[partner] == top).astype(int) + (current[partner] == c)
        peak = np.maximum(work[top] - gain, work[c] + gain)
        peak = np.where((held[c] + grow > capacity[c] + EPS) | (held[top] - grow > capacity[top] + EPS) | (moved > max_moves), np.inf, peak)
        if peak.min() < best:
            i, k = np.unravel_index(peak.argmin(), peak.shape)
            best, choice = peak[i, k], (int(own[i]), c, int(partner[i, k]))
    return best, choice


#: Keys up to which assignments are exact.
EXACT = 9


def _exact(size, load, current, capacity, max_moves, start):
    n, m = len(size), len(capacity)
    order = np.argsort(-load)
    best = [np.bincount(start, weights=load, minlength=m).max(), start.copy()]
    now, work, held = current.copy(), np.zeros(m), np.zeros(m)

    def go(k: int, moves: int) -> None:
        if k == n:
            if work.max() < best[0] - 1e-12:
                best[:] = [work.max(), now.copy()]
            return
        i = order[k]
        for j in sorted(range(m), key=lambda j: work[j]):
            more = moves + (j != current[i])
            if more > max_moves or held[j] + size[i] > capacity[j] + EPS or work[j] + load[i] >= best[0] - 1e-12:
                continue
            now[i] = j
            work[j] += load[i]
            held[j] += size[i]
            go(k + 1, more)
            work[j] -= load[i]
            held[j] -= size[i]
        now[i] = current[i]

    go(0, 0)
    return best[1]


def min_max(keys: DataFrame, capacity: list[float], max_moves: int) -> DataFrame:
    """scenario, k, server, moved, peak, bound, gap from (scenario, k, size, load, server); no assignment's peak is under the bound, gap = peak / bound - 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        load, now = pdf["load"].to_numpy(float), pdf["server"].to_numpy(int)
        to = assign(pdf["size"].to_numpy(float), load, now, np.array(capacity, float), max_moves)
        peak, bound = np.bincount(to, weights=load).max(), lower_bound(load, len(capacity), now, max_moves)
        return pd.DataFrame({"scenario": pdf["scenario"], "k": pdf["k"], "server": to, "moved": to != now, "peak": peak, "bound": bound, "gap": peak / bound - 1 if bound > EPS else 0.0})

    return keys.groupBy("scenario").applyInPandas(run, "scenario long, k int, server int, moved boolean, peak double, bound double, gap double")


#: Rebalance policies by name; others are refused.
POLICIES = ("greedy", "ilp")


def policy(name: str) -> str:
    if name not in POLICIES:
        raise ValueError(f"unknown policy: {name}")
    return name
