"""Queries on decoding, formats, logs and the series behind figures; and on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoded
from ..functions.numbers import shown
from ..operators import analysis, metrics, routing
from ..sources import report, runs, shared, trace
from .bind import bound, events, query, read, rounded
from .core import _STATS, _fanouts, _loads, _work


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM ev")
def props_decode(spark, sf_dir):
    p = encoded.decode(F.col("props"), "k int", F.struct(F.lit(-1).alias("k")))
    return events(spark, sf_dir).select("event_id", p.alias("p")).select("event_id", "p.k")


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE event_id END AS BIGINT) AS k FROM ev")
def decode_fallback(spark, sf_dir):
    r = F.col("event_id") % 4
    raw = F.when(r == 0, F.lit(None).cast("string")).when(r == 1, "  ").when(r == 2, "[1,").otherwise(F.format_string('{"k": %d}', "event_id"))
    p = encoded.decode(raw, "k bigint")["k"]
    return events(spark, sf_dir).select("event_id", F.coalesce(p, F.lit(-1)).cast("long").alias("k"))


@query("SELECT event_id, CAST(k AS INTEGER) AS key, round(cost, 6) AS value FROM ev")
def int_float_map(spark, sf_dir):
    raw = F.format_string('{"%d": "%s", "x": 2, "7y": 1, "9": "bad"}', "k", F.col("cost").cast("string"))
    return events(spark, sf_dir).select("event_id", F.explode(encoded.int_float_map(raw)).alias("key", "value"))


@query(", r AS (SELECT t, k, load, row_number() OVER (PARTITION BY t ORDER BY load DESC, k) AS n FROM loads) SELECT t, k AS key, round(load, 6) AS value FROM r WHERE n <= 5")
def map_topk(spark, sf_dir):
    maps = routing.cluster_loads(bound(spark, sf_dir).work).groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("k", "load"))).alias("m"))
    return maps.select("t", F.explode(encoded.largest(F.col("m"))).alias("e")).select("t", "e.key", "e.value")


@query("SELECT event_id, CASE WHEN x <> 0 AND abs(x) < 1e-4 THEN format('{:.6e}', x) ELSE format('{:.6f}', x) END AS shown FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(0 AS DOUBLE) WHEN event_id % 3 = 1 THEN CAST(event_id AS DOUBLE) / 8 ELSE CAST(event_id AS DOUBLE) / 16777216 / 4096 END AS x FROM ev)")
def fmt_number(spark, sf_dir):
    r = F.col("event_id") % 3
    x = F.when(r == 0, F.lit(0.0)).when(r == 1, F.col("event_id") / 8.0).otherwise(F.col("event_id") / 16777216.0 / 4096.0)
    return events(spark, sf_dir).select("event_id", shown(x).alias("shown"))


@query("SELECT t, round(CASE WHEN avg(util) > 1e-12 THEN max(util) / avg(util) ELSE 0 END, 6) AS imbalance FROM util GROUP BY t")
def imbalance_from_log(spark, sf_dir):
    """From utilisations that were logged as JSON maps."""
    logged = routing.utils(_loads(bound(spark, sf_dir))).groupBy("t").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("server").cast("string"), "util")))).alias("cell"))
    return metrics.imbalance(logged.select("t", F.explode(encoded.int_float_map(F.col("cell"))).alias("server", "util")))


_STEP = """SELECT t, '{"type":"step","t":' || t || ',"n":' || n || ',"servers":[' || s || ']}' AS line FROM (SELECT t, count(*) AS n, (SELECT string_agg(CAST(server AS VARCHAR), ',' ORDER BY server) FROM servers) AS s FROM ev GROUP BY t)"""


def _steps(spark, sf_dir):
    """t, place, line of a trace: an event for each tick."""
    b = bound(spark, sf_dir)
    step = b.work.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    everyone = b.servers.agg(F.sort_array(F.collect_list("server")).alias("servers"))
    return step.join(F.broadcast(everyone), F.lit(True)).select("t", F.lit(0).alias("place"), trace.event("step", "t", "n", "servers").alias("line"))


@query(_STEP)
def trace_lines(spark, sf_dir):
    return _steps(spark, sf_dir).select("t", "line")


@query(", n AS (SELECT t, count(*) AS n FROM ev GROUP BY t), k AS (SELECT t, k, CAST(count(*) AS INTEGER) AS cnt FROM ev GROUP BY t, k) SELECT t, n, CAST(8 AS INTEGER) AS n_servers, (SELECT max(cnt) FROM k WHERE k.t = n.t) AS most FROM n WHERE t > 24")
def trace_read_back(spark, sf_dir):
    """A trace of two kinds of events with nested cells, written as JSON lines and read as a data source, by type and tick."""
    counts = bound(spark, sf_dir).work.groupBy("t", "k").agg(F.count(F.lit(1)).alias("cnt"))
    cells = counts.groupBy("t").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), "cnt")))).alias("plan_counts"), F.max("cnt").alias("most"))
    states = cells.select("t", F.lit(1).alias("place"), trace.raw(trace.event("state", "t", "most"), ["plan_counts"]).alias("line"))
    path = f"{shared.folder(spark)}/trace"
    trace.write_trace([_steps(spark, sf_dir), states], path)
    steps = runs.trace(spark, path, "step", 25).select("t", *runs.fields("line", n="bigint"), F.size(F.expr("try_variant_get(try_parse_json(line), '$.servers', 'array<int>')")).alias("n_servers"))
    most = F.expr("array_max(map_values(try_variant_get(try_parse_json(line), '$.plan_counts', 'map<string,int>')))")
    return steps.join(runs.trace(spark, path, "state", 25).select("t", most.alias("most")), "t")


@query(
    ", w AS (SELECT t, sum(work) AS workload FROM work GROUP BY t), i AS (SELECT t, CASE WHEN avg(util) > 1e-12 THEN max(util) / avg(util) ELSE 0 END AS imbalance FROM util GROUP BY t), n AS (SELECT t, count(*) AS n_requests FROM ev GROUP BY t), c AS (SELECT t, CAST(to_json(map_from_entries(list((CAST(k AS VARCHAR), n) ORDER BY k))) AS VARCHAR) AS cells FROM (SELECT t, k, count(*) AS n FROM ev GROUP BY t, k) GROUP BY t)"
    " SELECT t, round(workload, 6) AS workload, round(imbalance, 6) AS imbalance, n_requests, cells AS cluster_loads, CAST(NULL AS DOUBLE) AS latency, " + ", ".join(f"(SELECT round(max(work), 6) FROM work WHERE work.t = w.t AND server = {x}) AS work_s{x}" for x in (0, 7)) + " FROM w JOIN i USING (t) JOIN n USING (t) JOIN c USING (t)"
)
def series_read_back(spark, sf_dir):
    """A time series written as wide CSV in its fixed order and read again: numbers, JSON cells with quotes, empty cells, columns of servers."""
    series, per = _series(spark, sf_dir)
    counts = bound(spark, sf_dir).work.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("k", "n")))
    cells = counts.groupBy("t").agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"].cast("string").alias("key"), e["n"].alias("value"))))).alias("cluster_loads"))
    wide = metrics.wide(per, list(range(8)), ["work", "util"])
    path = f"{shared.folder(spark)}/series"
    trace.write_series(series.join(cells, "t").join(wide, "t"), path, list(range(8)))
    back = trace.read_series(spark, path, [*trace.BASE, *trace.server_columns(list(range(8)))])
    return back.select("t", "workload", "imbalance", "n_requests", "cluster_loads", "latency", "work_s0", "work_s7")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 'OBJECT<k: BIGINT>' AS kind FROM ev")
def props_variant(spark, sf_dir):
    """Cells taken apart without a schema."""
    value = F.try_parse_json("props")
    return events(spark, sf_dir).select("event_id", F.try_variant_get(value, "$.k", "int").alias("k"), F.schema_of_variant(value).alias("kind"))


@query("SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS chars, CASE WHEN turn > 0 THEN turn - 1 END AS before FROM conversations", with_prelude=False)
def turns_variant(spark, sf_dir):
    """Turns as nested JSON of their own, read back field by field; `before` is missing in first turns."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.to_json(F.struct("turn", F.struct("role", "text").alias("said"), F.when(F.col("turn") > 0, F.struct((F.col("turn") - 1).alias("turn"))).alias("before"))).alias("cell"))
    get = lambda path, kind: F.try_variant_get(F.try_parse_json("cell"), path, kind)
    return turns.select("conv_id", get("$.turn", "bigint").alias("turn"), get("$.said.role", "string").alias("role"), F.length(get("$.said.text", "string")).alias("chars"), get("$.before.turn", "bigint").alias("before"))


def _series(spark, sf_dir):
    b = bound(spark, sf_dir)
    work, util = _work(b), routing.utils(_loads(b))
    ends = metrics.extremes(util, "server", "util", "hottest_server", "coldest_server").select("t", "hottest_server", "coldest_server")
    out = work.groupBy("t").agg(F.sum("work").alias("workload")).join(metrics.imbalance(util), "t").join(ends, "t")
    return out.join(b.work.groupBy("t").agg(F.count(F.lit(1)).alias("n_requests")), "t"), work.join(util, ["t", "server"])


_MEASURED = """, hi AS (SELECT t, server, row_number() OVER (PARTITION BY t ORDER BY util DESC, server) AS a, row_number() OVER (PARTITION BY t ORDER BY util, server) AS b FROM util),
ends AS (SELECT t, max(CASE WHEN a = 1 THEN server END) AS h, max(CASE WHEN b = 1 THEN server END) AS c FROM hi GROUP BY t), n AS (SELECT t, count(*) AS n FROM ev GROUP BY t),
im AS (SELECT t, CASE WHEN avg(util) > 1e-12 THEN max(util) / avg(util) ELSE 0 END AS i FROM util GROUP BY t), w AS (SELECT t, sum(work) AS w FROM work GROUP BY t),
m AS (SELECT t, 'workload' AS measure, 'run' AS "of", w AS value, 'work' AS unit FROM w UNION ALL SELECT t, 'imbalance', 'run', i, '' FROM im UNION ALL SELECT t, 'hottest_server', 'run', h, '' FROM ends UNION ALL SELECT t, 'coldest_server', 'run', c, '' FROM ends
  UNION ALL SELECT t, 'n_requests', 'run', n, '' FROM n UNION ALL SELECT t, 'work', 'server ' || server, work, 'work' FROM work UNION ALL SELECT t, 'util', 'server ' || server, util, 'of capacity' FROM util)"""


def _measures(spark, sf_dir):
    series, per = _series(spark, sf_dir)
    return [report.measured(series), report.measured(per, "server")]


@query(_MEASURED + ' SELECT t, measure, "of", round(CAST(value AS DOUBLE), 6) AS value, unit FROM m')
def tick_measures(spark, sf_dir):
    one, two = _measures(spark, sf_dir)
    return one.unionByName(two)


_SHOWN = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) WHEN abs(v) < 1e-4 THEN format('{:.6e}', v) ELSE format('{:.6f}', v) END"


@query(
    _MEASURED
    + f""", r AS (SELECT t, measure, "of", unit, round(CAST(value AS DOUBLE), 6) AS v FROM m), l AS (SELECT t, measure, "of", '- ' || measure || ' (' || "of" || ') = ' || {_SHOWN} || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END AS line FROM r)
    SELECT t, '## tick ' || t || chr(10) || string_agg(line, chr(10) ORDER BY measure, "of") AS text FROM l GROUP BY t"""
)
def narrative_log(spark, sf_dir):
    """The report of each tick."""
    return report.report([rounded(x) for x in _measures(spark, sf_dir)])


@query(_MEASURED + " SELECT n.t, '## tick ' || n.t || chr(10) || '- coldest_server (run) = ' || c || chr(10) || '- hottest_server (run) = ' || h AS text FROM n JOIN ends USING (t)")
def narrative_heads(spark, sf_dir):
    series, _ = _series(spark, sf_dir)
    return report.report([report.measured(series.select("t", "hottest_server", "coldest_server"))])


_HOT = ", tot AS (SELECT t, sum(work) AS workload FROM work GROUP BY t), hr AS (SELECT t, k, load, row_number() OVER (PARTITION BY t ORDER BY load DESC, k) AS n FROM loads WHERE k IN (t % 20, (t + 7) % 20, (t + 11) % 20)), hc AS (SELECT t, sum(load) AS hot, max(CASE WHEN n = 1 THEN load END) AS p, max(CASE WHEN n = 2 THEN load END) AS s FROM hr GROUP BY t)"


@query(_HOT + " SELECT t, round(coalesce(hot, 0), 6) AS hot, round(greatest(0, workload - coalesce(hot, 0)), 6) AS cold, round(coalesce(p, 0), 6) AS \"primary\", round(coalesce(s, 0), 6) AS secondary FROM tot LEFT JOIN hc USING (t)")
def hot_cold_workload(spark, sf_dir):
    b = bound(spark, sf_dir)
    totals = _work(b).groupBy("t").agg(F.sum("work").alias("workload"))
    keys = F.array(*[((F.col("t") + d) % 20).cast("int") for d in (0, 7, 11)])
    return analysis.hot_cold_workload(routing.cluster_loads(b.work), totals.select("t", F.explode(keys).alias("k")), totals)


@query(""", cnts AS (SELECT t, k, count(*) AS cnt FROM ev GROUP BY t, k), r AS (SELECT t, sum(cnt) AS n, sum(CASE WHEN k IN (t % 20, (t + 7) % 20) THEN cnt ELSE 0 END) / sum(cnt) AS h FROM cnts GROUP BY t)
SELECT t, round(n * h, 6) AS hot_probe_units, round(greatest(0, n * (1 - h)), 6) AS cold_probe_units FROM r""")
def probe_units(spark, sf_dir):
    from .core import _hot_ratio

    return analysis.probe_units(_hot_ratio(spark, sf_dir))


_PER_TICK = ", per AS (SELECT t, sum(cost) AS v FROM ev GROUP BY t)"


def _per_tick(spark, sf_dir):
    return bound(spark, sf_dir).work.groupBy("t").agg(F.sum("cost").alias("v"))


@query(_PER_TICK + ", c AS (SELECT t, min(v) OVER w AS low, max(v) OVER w AS high, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM per WINDOW w AS (ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) SELECT t, round(low, 6) AS low, round(greatest(low, mu - sd), 6) AS open, round(least(high, mu + sd), 6) AS close, round(high, 6) AS high FROM c")
def rolling_candles(spark, sf_dir):
    return analysis.rolling_candles(_per_tick(spark, sf_dir), "v", 24)


@query(_STATS + " SELECT t, fanout_req_min AS low, round(greatest(fanout_req_min, fanout_req_mean - sqrt(fanout_req_var)), 6) AS open, round(least(fanout_req_max, fanout_req_mean + sqrt(fanout_req_var)), 6) AS close, fanout_req_max AS high FROM stats")
def request_candles(spark, sf_dir):
    return analysis.request_candles(metrics.fanout_stats(_fanouts(spark, sf_dir)), 24)


@query(_PER_TICK + ", c AS (SELECT t, min(v) OVER w AS low, max(v) OVER w AS high, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM per WINDOW w AS (ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT t, round(low, 6) AS low, round(greatest(low, mu - sd), 6) AS open, round(least(high, mu + sd), 6) AS close, round(high, 6) AS high FROM c")
def request_candles_unsampled(spark, sf_dir):
    """A run without any samples of requests: rolling candles of the mean."""
    v = F.col("v")
    stats = _per_tick(spark, sf_dir).select("t", F.lit(0).alias("fanout_req_samples"), v.alias("fanout_req_mean"), v.alias("fanout_req_min"), v.alias("fanout_req_max"), F.lit(0.0).alias("fanout_req_var"))
    return analysis.request_candles(stats, 12)


@query(", a AS (SELECT t, sum(cost) AS v FROM ev WHERE event_type = 'click' GROUP BY t) SELECT t, round(v, 6) AS v_click FROM a")
def scenario_compare_missing(spark, sf_dir):
    """One of two runs has no such metric and is left out."""
    e = events(spark, sf_dir)
    runs_ = {"click": e.where("event_type = 'click'").groupBy("t").agg(F.sum("cost").alias("v")), "other": e.groupBy("t").agg(F.max("cost").alias("w"))}
    return analysis.compare(runs_, "v")


@query(_PER_TICK + " SELECT t, round(v, 6) AS v, v >= coalesce(lag(v) OVER (ORDER BY t), v) AS up FROM per")
def candle_direction(spark, sf_dir):
    return analysis.direction(_per_tick(spark, sf_dir), "v")


@query("SELECT t, CASE WHEN t = 50 THEN 'rebalance' ELSE '' END AS label FROM ticks WHERE t % 50 = 0")
def rebalance_markers(spark, sf_dir):
    t = bound(spark, sf_dir).work.select("t").distinct()
    return analysis.markers(t.withColumn("rebalance", (F.col("t") % 50 == 0).cast("int")))


@query(", a AS (SELECT t, sum(cost) AS v FROM ev WHERE event_type = 'click' GROUP BY t), b AS (SELECT t, sum(cost) AS v FROM ev WHERE event_type <> 'click' GROUP BY t) SELECT t, round(a.v, 6) AS v_click, round(b.v, 6) AS v_other FROM a FULL JOIN b USING (t)")
def scenario_compare(spark, sf_dir):
    e = events(spark, sf_dir)
    runs = {"click": e.where("event_type = 'click'"), "other": e.where("event_type <> 'click'")}
    return analysis.compare({n: r.groupBy("t").agg(F.sum("cost").alias("v")) for n, r in runs.items()}, "v")


@query("SELECT CAST(NULL AS VARCHAR) AS extra, 'a' AS run, round(avg(cost), 6) AS mean_cost, min(k) AS least FROM ev UNION ALL SELECT 'x', 'b', round(max(cost), 6), CAST(NULL AS INTEGER) FROM ev")
def sweep_union(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.agg(F.avg("cost").alias("mean_cost"), F.min("k").alias("least")).withColumn("run", F.lit("a"))
    b = e.agg(F.max("cost").alias("mean_cost")).withColumn("run", F.lit("b")).withColumn("extra", F.lit("x"))
    return trace.union_long([a, b])


@query(_PER_TICK + " SELECT count(*) AS ticks, round(arg_max(v, t), 6) AS final FROM per")
def summary_row(spark, sf_dir):
    out = trace.run_summary(_per_tick(spark, sf_dir), {"policy": "greedy"})
    return out.select(F.col("final.rows").alias("ticks"), F.col("final.v").alias("final"))


# ---- vectors: lists are labels, a centroid is the mean of its vectors

_IVF = """WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM x GROUP BY label, i)"""


def _centroids(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return x.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))


def _probed(spark, sf_dir, n):
    """Centroids travel as one row: as many arrays as there are lists."""
    per_list = _centroids(spark, sf_dir).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda e: e["c"]).alias("c"))
    lists = per_list.agg(F.collect_list(F.struct("label", "c")).alias("lists"))
    gap = lambda entry: F.aggregate(F.zip_with("embedding", entry["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    scored = F.slice(F.array_sort(F.transform("lists", lambda e: F.struct(F.round(gap(e), 9).alias("d"), e["label"].alias("label")))), 1, n)
    vectors = read(spark, sf_dir, "embeddings").join(F.broadcast(lists), F.lit(True))
    return vectors.select("vec_id", F.posexplode(scored).alias("place", "e")).select("vec_id", (F.col("place") + 1).alias("place"), F.col("e.label").alias("list"), F.col("e.d").alias("distance"))


@query(_IVF + " SELECT label, CAST(i - 1 AS INTEGER) AS i, round(c, 6) AS c FROM c", with_prelude=False)
def ivf_centroids(spark, sf_dir):
    return _centroids(spark, sf_dir)


_NEAR = _IVF + ", d AS (SELECT vec_id, c.label AS list, round(sum((x - c) * (x - c)), 9) AS d FROM x JOIN c USING (i) GROUP BY vec_id, c.label), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, list) AS n FROM d)"


@query(_NEAR + " SELECT vec_id, CAST(n AS INTEGER) AS place, list FROM r WHERE n <= 3", with_prelude=False)
def ivf_nprobe(spark, sf_dir):
    return _probed(spark, sf_dir, 3).select("vec_id", "place", "list")


@query(_NEAR + " SELECT list, count(*) AS probes FROM r WHERE n <= 3 GROUP BY list", with_prelude=False)
def ivf_list_load(spark, sf_dir):
    return _probed(spark, sf_dir, 3).groupBy("list").agg(F.count(F.lit(1)).alias("probes"))
