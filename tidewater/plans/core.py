"""Queries on layouts, routing and tick metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..operators import layout, metrics, routing
from ..sources.shared import written
from .bind import bound, query


def _loads(b):
    return routing.server_loads(b.work, b.slices, b.servers)


def _work(b):
    raw = routing.biased_work(b.work, b.slices, layout.primaries(b.slices))
    return routing.densified(raw, b.servers.select("server"), "server", "work")


def _ticks(b):
    """t, server, capacity, load, work, worked out once."""
    return written(routing.server_ticks(b.work, b.slices, b.servers, layout.primaries(b.slices)))


@query("SELECT slice_id, lo, hi, round(size, 6) AS size, server FROM home")
def layout_multi_shard(spark, sf_dir):
    return bound(spark, sf_dir).home


@query("SELECT CAST(k // 5 + 1 AS BIGINT) AS slice_id, min(k) AS lo, max(k) + 1 AS hi, sum(size) AS size, k // 5 % 8 AS server FROM keys GROUP BY k // 5")
def layout_chunked(spark, sf_dir):
    return layout.chunked(bound(spark, sf_dir).keys, 5, 8)


@query(
    """, cuts AS (SELECT DISTINCT CAST(s_nationkey % 19 + 1 AS INTEGER) AS cut FROM supplier),
    starts AS (SELECT cut AS lo FROM cuts UNION SELECT 0),
    ranges AS (SELECT row_number() OVER (ORDER BY lo) AS slice_id, lo, coalesce(lead(lo) OVER (ORDER BY lo), 20) AS hi FROM starts)
    SELECT slice_id, lo, hi, sum(size) AS size, CAST((slice_id - 1) % 8 AS INTEGER) AS server FROM ranges JOIN keys ON k >= lo AND k < hi GROUP BY slice_id, lo, hi"""
)
def layout_cuts(spark, sf_dir):
    cuts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_nationkey") % 19 + 1).alias("cut")).distinct()
    return layout.from_cuts(bound(spark, sf_dir).keys, cuts, 8)


@query("SELECT k, slice_id, server, round(size, 6) AS size, CAST(1 AS INTEGER) AS span, CAST(nth AS INTEGER) AS nth FROM keymap")
def keymap(spark, sf_dir):
    return layout.keymap(bound(spark, sf_dir).slices)


@query("SELECT k, server FROM prim")
def primary_server(spark, sf_dir):
    return layout.primaries(bound(spark, sf_dir).slices)


@query("SELECT 'uncovered' AS fault, count(*) AS n FROM keys WHERE k NOT IN (SELECT k FROM keymap) UNION ALL SELECT 'over_capacity', count(*) FROM (SELECT server FROM slices JOIN servers USING (server) GROUP BY server, capacity HAVING sum(size) > capacity)")
def invariants(spark, sf_dir):
    b = bound(spark, sf_dir)
    bad = layout.uncovered(b.keys, b.slices).select(F.lit("uncovered").alias("fault")).unionByName(layout.over_capacity(b.slices, b.servers).select(F.lit("over_capacity").alias("fault")))
    names = spark.createDataFrame([("uncovered",), ("over_capacity",)], "fault string")
    return names.join(bad.groupBy("fault").agg(F.count(F.lit(1)).alias("n")), "fault", "left").na.fill(0)


@query("SELECT server, count(*) AS slice_count, round(sum(size), 6) AS keyspace FROM slices WHERE server IN (2, 5) GROUP BY server")
def slices_on_servers(spark, sf_dir):
    b = bound(spark, sf_dir)
    return layout.per_server(b.slices.where("server IN (2, 5)"), b.servers.where("server IN (2, 5)")).select("server", "slice_count", "keyspace")


@query("SELECT k AS cluster, CAST(to_json(list(slice_id ORDER BY nth)) AS VARCHAR) AS slices, CAST(to_json(list(server ORDER BY nth)) AS VARCHAR) AS servers, count(*) AS n FROM keymap GROUP BY k")
def layout_snapshot(spark, sf_dir):
    snap = layout.snapshot(bound(spark, sf_dir).slices)
    return snap.select("cluster", F.to_json("slices").alias("slices"), F.to_json("servers").alias("servers"), F.size("slices").cast("long").alias("n"))


@query("SELECT server, round(coalesce(sum(size), 0), 6) AS keyspace, count(slice_id) AS slice_count FROM servers LEFT JOIN slices USING (server) GROUP BY server")
def keyspace_per_server(spark, sf_dir):
    b = bound(spark, sf_dir)
    return layout.per_server(b.slices, b.servers)


@query("SELECT t, k, round(load, 6) AS load FROM loads")
def cluster_loads(spark, sf_dir):
    return routing.cluster_loads(bound(spark, sf_dir).work)


@query("SELECT t, k, slice_id, server, round(load, 6) AS load FROM alloc")
def allocate_key_cost(spark, sf_dir):
    b = bound(spark, sf_dir)
    return routing.allocate(b.work, b.slices)


@query("SELECT t, slice_id, server, round(coalesce(sum(alloc.load), 0), 6) AS load FROM ticks CROSS JOIN slices LEFT JOIN alloc USING (t, slice_id, server) GROUP BY t, slice_id, server")
def slice_loads(spark, sf_dir):
    b = bound(spark, sf_dir)
    return routing.slice_loads(b.work, b.slices)


@query("SELECT t, server, round(work, 6) AS work FROM work")
def server_work_biased(spark, sf_dir):
    return _work(bound(spark, sf_dir))


@query("SELECT DISTINCT k FROM ev WHERE k NOT IN (SELECT k FROM keymap WHERE k < 17)")
def unrouted_keys(spark, sf_dir):
    b = bound(spark, sf_dir)
    return routing.unrouted(b.work, b.slices.where("lo < 17"))


@query("SELECT t, server, capacity, round(load, 6) AS load FROM sload")
def server_loads(spark, sf_dir):
    return _loads(bound(spark, sf_dir))


@query("SELECT t, server, round(util, 6) AS util FROM util")
def server_util(spark, sf_dir):
    return routing.utils(_loads(bound(spark, sf_dir)))


@query(
    """, idle AS (SELECT t, server, capacity, CASE WHEN t % 3 = 0 THEN 0 ELSE load END AS load FROM sload),
    recent AS (SELECT t, server, sum(work) OVER (PARTITION BY server ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM work),
    total AS (SELECT t, sum(load) AS total FROM idle GROUP BY t)
    SELECT t, server, round((CASE WHEN total > 1e-12 THEN load ELSE recent END) / capacity, 6) AS util FROM idle JOIN total USING (t) JOIN recent USING (t, server)"""
)
def server_util_from_history(spark, sf_dir):
    b = bound(spark, sf_dir)
    idle = _loads(b).withColumn("load", F.when(F.col("t") % 3 == 0, 0.0).otherwise(F.col("load")))
    return routing.utils(idle, routing.recent_work(_work(b), 5))


@query("SELECT t, round(CASE WHEN avg(util) > 1e-12 THEN max(util) / avg(util) ELSE 0 END, 6) AS imbalance FROM util GROUP BY t")
def imbalance_by_tick(spark, sf_dir):
    return metrics.imbalance(routing.utils(_loads(bound(spark, sf_dir))))


@query("SELECT t, round(CASE WHEN avg(util) > 1e-12 THEN max(util) / avg(util) ELSE 0 END, 6) AS imbalance FROM util GROUP BY t", "lineitem")
def imbalance_by_month(spark, sf_dir):
    return metrics.imbalance(routing.utils(_loads(bound(spark, sf_dir, "lineitem"))))


@query("SELECT t, server, round(work, 6) AS work FROM work", "lineitem")
def server_work_by_month(spark, sf_dir):
    return _work(bound(spark, sf_dir, "lineitem"))


@query("SELECT t, round(CASE WHEN avg(work) > 1e-12 THEN max(work) / avg(work) ELSE 0 END, 6) AS work_imbalance FROM work GROUP BY t")
def imbalance_from_work(spark, sf_dir):
    return metrics.imbalance(_work(bound(spark, sf_dir)), "work", "work_imbalance")


def _extremes_sql(table: str, key: str, value: str, high: str, low: str) -> str:
    return f""", hi AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {value} DESC, {key}) AS n FROM {table}), lo AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {value}, {key}) AS n FROM {table})
    SELECT hi.t, hi.{key} AS {high}, round(hi.{value}, 6) AS {high}_value, lo.{key} AS {low}, round(lo.{value}, 6) AS {low}_value FROM hi JOIN lo ON hi.t = lo.t WHERE hi.n = 1 AND lo.n = 1"""


@query(_extremes_sql("util", "server", "util", "hottest_server", "coldest_server"))
def hot_cold_server(spark, sf_dir):
    return metrics.extremes(routing.utils(_loads(bound(spark, sf_dir))), "server", "util", "hottest_server", "coldest_server")


@query(_extremes_sql("work", "server", "work", "hottest_work_server", "coldest_work_server"))
def hot_cold_work_server(spark, sf_dir):
    return metrics.extremes(_work(bound(spark, sf_dir)), "server", "work", "hottest_work_server", "coldest_work_server")


@query(", sl AS (SELECT t, slice_id, coalesce(sum(alloc.load), 0) AS load FROM ticks CROSS JOIN slices LEFT JOIN alloc USING (t, slice_id) GROUP BY t, slice_id)" + _extremes_sql("sl", "slice_id", "load", "hottest_slice", "coldest_slice"))
def hot_cold_slice(spark, sf_dir):
    b = bound(spark, sf_dir)
    return metrics.extremes(routing.slice_loads(b.work, b.slices), "slice_id", "load", "hottest_slice", "coldest_slice")


@query("SELECT t, round(sum(work), 6) AS workload, round(avg(work), 6) AS mean_work FROM work GROUP BY t")
def workload_by_tick(spark, sf_dir):
    return _work(bound(spark, sf_dir)).groupBy("t").agg(F.sum("work").alias("workload"), F.avg("work").alias("mean_work"))


@query("SELECT t, CAST(count(DISTINCT server) AS DOUBLE) AS fanout FROM routed GROUP BY t")
def fanout_by_tick(spark, sf_dir):
    b = bound(spark, sf_dir)
    return metrics.fanout(routing.biased_work(b.work, b.slices, layout.primaries(b.slices)))


def _probes(spark, sf_dir):
    """Each event probes its own key and two that follow from it."""
    from .bind import events

    probed = F.explode(F.array("k", ((F.col("k") * 3 + 1) % 20).cast("int"), ((F.col("k") + F.col("event_id") % 7) % 20).cast("int")))
    return events(spark, sf_dir).select("t", F.col("event_id").alias("request"), probed.alias("k")).distinct()


_FANOUTS = """, probe AS (SELECT DISTINCT t, event_id AS request, unnest([k, (k * 3 + 1) % 20, (k + event_id % 7) % 20]) AS k FROM ev),
fan AS (SELECT t, request, CAST(count(DISTINCT server) AS DOUBLE) AS fanout FROM probe JOIN keymap USING (k) GROUP BY t, request)"""


def _fanouts(spark, sf_dir):
    return metrics.request_fanouts(_probes(spark, sf_dir), layout.keymap(bound(spark, sf_dir).slices))


@query(_FANOUTS + " SELECT t, request, fanout FROM fan")
def fanout_per_request(spark, sf_dir):
    return _fanouts(spark, sf_dir)


_STATS = _FANOUTS + ", stats AS (SELECT t, count(*) AS fanout_req_samples, avg(fanout) AS fanout_req_mean, min(fanout) AS fanout_req_min, max(fanout) AS fanout_req_max, var_pop(fanout) AS fanout_req_var FROM fan GROUP BY t)"


@query(_STATS + " SELECT t, fanout_req_samples, round(fanout_req_mean, 6) AS fanout_req_mean, fanout_req_min, fanout_req_max, round(fanout_req_var, 6) AS fanout_req_var FROM stats")
def fanout_stats(spark, sf_dir):
    return metrics.fanout_stats(_fanouts(spark, sf_dir))


@query(_STATS + """, n AS (SELECT t, fanout_req_mean AS m, row_number() OVER (ORDER BY t) AS n, var_pop(fanout_req_mean) OVER (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM stats)
SELECT t, round(CASE WHEN t > 10 AND n >= 2 THEN v ELSE 0 END, 6) AS fanout_var, CAST(t <= 10 AS INTEGER) AS burn_in FROM n""")
def fanout_rolling_var(spark, sf_dir):
    found = metrics.rolling_variances(metrics.fanout_stats(_fanouts(spark, sf_dir)), "fanout_req_mean", 20, 10)
    return found.select("t", F.col("variance").alias("fanout_var"), (F.col("t") <= 10).cast("int").alias("burn_in"))


@query(""", cnts AS (SELECT t, k, count(*) AS cnt FROM ev GROUP BY t, k)
SELECT t, CAST(sum(cnt) AS BIGINT) AS work_units, round(sum(CASE WHEN k IN (t % 20, (t + 7) % 20) THEN cnt ELSE 0 END) / sum(cnt), 6) AS hot_probe_ratio FROM cnts GROUP BY t""")
def hot_probe_ratio(spark, sf_dir):
    return _hot_ratio(spark, sf_dir)


def _hot_ratio(spark, sf_dir):
    counts = bound(spark, sf_dir).work.groupBy("t", "k").agg(F.count(F.lit(1)).alias("cnt"))
    hot = counts.select("t").distinct().select("t", F.explode(F.array((F.col("t") % 20).cast("int"), ((F.col("t") + 7) % 20).cast("int"))).alias("k"))
    return metrics.hot_ratio(counts, hot)


_HEAT = ", heat AS (SELECT t, server, work, power(CAST(0.98 AS DOUBLE), t + 1) * sum(CAST(0.01 AS DOUBLE) * work * power(CAST(0.98 AS DOUBLE), -t)) OVER (PARTITION BY server ORDER BY t) AS heat FROM work), lat AS (SELECT *, work * (1 + CAST(0.0005 AS DOUBLE) * coalesce(lag(heat) OVER (PARTITION BY server ORDER BY t) * power(CAST(0.98 AS DOUBLE), t - 1 - lag(t) OVER (PARTITION BY server ORDER BY t)), 0)) AS latency FROM heat)"


@query(_HEAT + " SELECT t, server, round(work, 6) AS work, round(latency, 6) AS latency, round(heat, 6) AS heat FROM lat")
def heat_series(spark, sf_dir):
    return metrics.heat(_work(bound(spark, sf_dir)))


@query(_HEAT + " SELECT t, round(sum(latency), 6) AS latency FROM lat GROUP BY t")
def latency_series(spark, sf_dir):
    return metrics.heat(_work(bound(spark, sf_dir))).groupBy("t").agg(F.sum("latency").alias("latency"))


@query(
    """, rq AS (SELECT t, event_id AS request, server, cost * share AS work FROM ev JOIN shares USING (k)), rr AS (SELECT t, request, server, sum(work) AS work FROM rq GROUP BY t, request, server),
    pt AS (SELECT t, server, coalesce(sum(rr.work), 0) AS work FROM ticks CROSS JOIN (SELECT DISTINCT server FROM rr) LEFT JOIN rr USING (t, server) GROUP BY t, server),
    ht AS (SELECT t, server, power(CAST(0.98 AS DOUBLE), t + 1) * sum(CAST(0.01 AS DOUBLE) * work * power(CAST(0.98 AS DOUBLE), -t)) OVER (PARTITION BY server ORDER BY t) AS heat FROM pt),
    st AS (SELECT t, server, coalesce(lag(heat) OVER (PARTITION BY server ORDER BY t) * power(CAST(0.98 AS DOUBLE), t - 1 - lag(t) OVER (PARTITION BY server ORDER BY t)), 0) AS start FROM ht),
    so AS (SELECT *, coalesce(sum(work) OVER (PARTITION BY t, server ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rr)
    SELECT t, request, server, round(work, 6) AS work, round(work * (1 + CAST(0.0005 AS DOUBLE) * (start + CAST(0.01 AS DOUBLE) * before)), 6) AS latency FROM so JOIN st USING (t, server)"""
)
def latency_per_request(spark, sf_dir):
    from .bind import events

    b = bound(spark, sf_dir)
    routed = events(spark, sf_dir).join(routing.shares(b.slices), "k").groupBy("t", F.col("event_id").alias("request"), "server").agg(F.sum(F.col("cost") * F.col("share")).alias("work"))
    return metrics.request_latency(routed)


_P95 = _HEAT + ", ticklat AS (SELECT t, sum(latency) AS latency FROM lat GROUP BY t), ranked AS (SELECT latency, row_number() OVER (ORDER BY latency) AS r, count(*) OVER () AS n FROM ticklat)"


@query(_P95 + " SELECT round(latency, 6) AS p95_latency FROM ranked WHERE r = floor(CAST(0.95 AS DOUBLE) * (n - 1)) + 1")
def latency_p95(spark, sf_dir):
    latency = metrics.heat(_work(bound(spark, sf_dir))).groupBy("t").agg(F.sum("latency").alias("latency"))
    return metrics.p95(latency, "latency")


@query(_P95 + """, imb AS (SELECT t, max(util) / avg(util) AS imbalance FROM util GROUP BY t), final AS (SELECT server, arg_max(heat, t) AS heat FROM heat GROUP BY server)
SELECT (SELECT round(avg(latency), 6) FROM ticklat) AS avg_latency, (SELECT round(latency, 6) FROM ranked WHERE r = floor(CAST(0.95 AS DOUBLE) * (n - 1)) + 1) AS p95_latency,
(SELECT round(arg_max(imbalance, t), 6) FROM imb) AS imbalance, (SELECT server FROM final ORDER BY heat DESC, server LIMIT 1) AS hottest_server, (SELECT round(max(heat), 6) FROM final) AS max_server_heat""")
def run_summary(spark, sf_dir):
    per = _ticks(bound(spark, sf_dir))
    heats = written(metrics.heat(per.select("t", "server", "work")))
    latency = heats.groupBy("t").agg(F.sum("latency").alias("latency"))
    return metrics.summary(latency, metrics.imbalance(routing.utils(per)), heats)


@query("SELECT t, server, round(sum(work) OVER (PARTITION BY server, (t - 1) // 50 ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS recent FROM work")
def rolling_work(spark, sf_dir):
    return routing.recent_work(_work(bound(spark, sf_dir)), 20, 50)


@query(""", imb AS (SELECT t, max(util) / avg(util) AS imbalance FROM util GROUP BY t), w AS (SELECT t, max(work) / avg(work) AS wi FROM work GROUP BY t)
SELECT t, round(imbalance, 6) AS imbalance, round(coalesce(lag(imbalance) OVER (ORDER BY t), wi), 6) AS imbalance_pre FROM imb JOIN w USING (t)""")
def imbalance_pre_lag(spark, sf_dir):
    per = _ticks(bound(spark, sf_dir))
    per = per.withColumn("util", ratio(F.col("load"), F.col("capacity")))
    both = per.groupBy("t").agg(ratio(F.max("util"), F.avg("util")).alias("imbalance"), ratio(F.max("work"), F.avg("work")).alias("first"))
    return both.select("t", "imbalance", metrics.before(both, "imbalance", F.col("first")).alias("imbalance_pre"))


_FIVE = ("work", "keyspace", "heat", "util", "slicecount")


@query(
    _HEAT
    + ", ks AS (SELECT server, coalesce(sum(size), 0) AS keyspace, CAST(count(slice_id) AS BIGINT) AS slicecount FROM servers LEFT JOIN slices USING (server) GROUP BY server), five AS (SELECT * FROM heat JOIN util USING (t, server) JOIN ks USING (server)) SELECT t, "
    + ", ".join(f"round(max(CASE WHEN server = {s} THEN {m} END), 6) AS {m}_s{s}" if m != "slicecount" else f"max(CASE WHEN server = {s} THEN {m} END) AS {m}_s{s}" for m in _FIVE for s in range(8))
    + " FROM five GROUP BY t"
)
def server_pivot(spark, sf_dir):
    """All five measures of each server side by side."""
    b = bound(spark, sf_dir)
    per = metrics.heat(_work(b)).join(routing.utils(_loads(b)), ["t", "server"])
    held = layout.per_server(b.slices, b.servers).withColumnRenamed("slice_count", "slicecount")
    return metrics.wide(per.join(held, "server"), list(range(8)), list(_FIVE))


@query("SELECT server, CAST(round_even(server * 12.5::DOUBLE, 0) AS BIGINT) AS half_even, round(CASE WHEN server % 2 = 0 THEN capacity / 7 ELSE 0 END, 6) AS guarded FROM servers")
def guarded_scalars(spark, sf_dir):
    from ..functions.numbers import half_even, ratio

    s = bound(spark, sf_dir).servers
    return s.select("server", half_even(F.col("server") * 12.5).alias("half_even"), ratio(F.col("capacity"), F.when(F.col("server") % 2 == 0, 7.0).otherwise(0.0)).alias("guarded"))


@query(", r AS (SELECT t, server, round(work + 3e-9, 4) AS work FROM work) SELECT t, server, round(sum(work) OVER (PARTITION BY server ORDER BY t), 6) AS cumulative_work, round(sum(work) OVER (PARTITION BY server, (t - 1) // 50 ORDER BY t), 6) AS window_work FROM r")
def server_work_totals(spark, sf_dir):
    """Of work to four decimals, so that long sums do not differ by their order."""
    return metrics.worked(_work(bound(spark, sf_dir)).withColumn("work", F.round(F.col("work") + 3e-9, 4)), 50)


@query(_FANOUTS + ", both_ AS (SELECT k, server FROM keymap UNION SELECT k, server FROM prim0), bf AS (SELECT t, request, CAST(count(DISTINCT server) AS DOUBLE) AS f FROM probe JOIN both_ USING (k) GROUP BY t, request) SELECT t, round(avg(f), 6) AS fanout FROM bf GROUP BY t".replace("prim0", "(SELECT lo AS k, server FROM home QUALIFY row_number() OVER (PARTITION BY lo ORDER BY size DESC, slice_id) = 1)"))
def fanout_biased_per_request(spark, sf_dir):
    """Mean fan-out of requests, with the primaries of the first layout."""
    b = bound(spark, sf_dir)
    found = metrics.request_fanouts(_probes(spark, sf_dir), layout.keymap(b.slices), layout.primaries(b.home))
    return found.groupBy("t").agg(F.avg("fanout").alias("fanout"))


@query(_STATS + """, f AS (SELECT t, CAST(count(DISTINCT server) AS DOUBLE) AS fanout FROM routed GROUP BY t), s AS (SELECT * FROM stats WHERE t % 3 <> 0)
SELECT t, coalesce(fanout_req_samples, 0) AS fanout_req_samples, round(coalesce(fanout_req_mean, fanout), 6) AS fanout_req_mean, coalesce(fanout_req_min, fanout) AS fanout_req_min, coalesce(fanout_req_max, fanout) AS fanout_req_max, round(coalesce(fanout_req_var, 0), 6) AS fanout_req_var FROM f LEFT JOIN s USING (t)""")
def fanout_stats_unsampled(spark, sf_dir):
    """Ticks divisible by three have no samples."""
    b = bound(spark, sf_dir)
    ticks = metrics.fanout(routing.biased_work(b.work, b.slices, layout.primaries(b.slices)))
    return metrics.fanout_stats(_fanouts(spark, sf_dir).where("t % 3 <> 0"), ticks)


@query("SELECT t, server, capacity, round(load, 6) AS load FROM sload WHERE server = 3")
def one_server_load(spark, sf_dir):
    return routing.of_server(_loads(bound(spark, sf_dir)), 3)


@query(", busy AS (SELECT * FROM work WHERE (t + server) % 4 > 0 AND work > 0) SELECT t, server, round(sum(work) OVER (PARTITION BY server ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS recent FROM busy")
def rolling_work_touched(spark, sf_dir):
    work = _work(bound(spark, sf_dir)).withColumn("work", F.when((F.col("t") + F.col("server")) % 4 > 0, F.col("work")).otherwise(0.0))
    return routing.recent_work(work, 20, touched=True)


@query("SELECT t, server, capacity, round(load, 6) AS load, round(work, 6) AS work FROM sload JOIN work USING (t, server)")
def server_ticks(spark, sf_dir):
    b = bound(spark, sf_dir)
    return routing.server_ticks(b.work, b.slices, b.servers, layout.primaries(b.slices))


def _state(spark, sf_dir):
    b = bound(spark, sf_dir)
    return layout.state(b.slices, b.slices.select("slice_id", (F.col("size") * 2).alias("load")).where("slice_id % 5 > 0"))


@query("SELECT CAST(row_number() OVER (ORDER BY slice_id) - 1 AS INTEGER) AS place, slice_id, lo, hi, lo AS cluster, round(size, 6) AS size, round(CASE WHEN slice_id % 5 > 0 THEN size * 2 ELSE 0 END, 6) AS load, server FROM slices")
def state_slices(spark, sf_dir):
    return _state(spark, sf_dir).select(F.posexplode("slices").alias("place", "s")).select("place", "s.*")


@query("SELECT k, min(CASE WHEN nth = 1 THEN slice_id END) AS slice_id, min(CASE WHEN nth = 1 THEN server END) AS server, list(slice_id ORDER BY nth)::VARCHAR AS slices, list(server ORDER BY nth)::VARCHAR AS servers, round(sum(size), 6) AS size FROM keymap GROUP BY k")
def state_keys(spark, sf_dir):
    rows = F.arrays_zip("key_to_slice", "key_to_server", "cluster_to_slices", "cluster_to_servers", "cluster_shard_sizes")
    total = F.aggregate("e.cluster_shard_sizes", F.lit(0.0), lambda a, x: a + x)
    text = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))
    return _state(spark, sf_dir).select(F.posexplode(rows).alias("k", "e")).select("k", F.col("e.key_to_slice").alias("slice_id"), F.col("e.key_to_server").alias("server"), text("e.cluster_to_slices").alias("slices"), text("e.cluster_to_servers").alias("servers"), total.alias("size"))
