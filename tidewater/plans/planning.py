"""Queries on workloads and probe planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import uniform
from ..operators import layout, metrics, planner, workload
from .bind import bound, events, query, read

_U = "CAST(CAST('0x' || substr(md5(CAST({a} AS VARCHAR) || ':' || CAST({b} AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


def u(a: str, b: str) -> str:
    return _U.format(a=a, b=b)


_ZIPF = f", zipf AS (SELECT k, w / sum(w) OVER () AS prob FROM (SELECT k, 1 / power(row_number() OVER (ORDER BY {u('k', '1')}, k), CAST(1.1 AS DOUBLE)) AS w FROM keys))"


def _zipf(spark, sf_dir):
    return workload.popularity(bound(spark, sf_dir).keys, 1.1)


@query(_ZIPF + " SELECT k, round(prob, 6) AS prob FROM zipf")
def zipf_weights(spark, sf_dir):
    return _zipf(spark, sf_dir)


@query("SELECT CAST(n_servers * 10000 AS BIGINT) AS requests_mean, CAST(n_servers * 2000 AS BIGINT) AS requests_std, CAST(n_servers * 4000 AS BIGINT) AS requests_min, CAST(n_servers * 16000 AS BIGINT) AS requests_max FROM (SELECT server + 1 AS n_servers FROM servers)")
def request_bounds(spark, sf_dir):
    b = bound(spark, sf_dir)
    n = b.servers.select((F.col("server") + 1).cast("long").alias("n"))
    return n.select(*[c.alias(name) for name, c in workload.request_bounds(F.col("n"), F.lit(10000)).items()])


_NORMAL = f"sqrt(-2 * ln(({u('t', '3')} * 0.999 + 0.0005))) * cos(2 * pi() * {u('t', '11')})"


def _gauss(a, b1=3, b2=11):
    """Box and Muller over two keyed uniforms."""
    return F.sqrt(-2 * F.ln(uniform(a, F.lit(b1)) * 0.999 + 0.0005)) * F.cos(2 * F.pi() * uniform(a, F.lit(b2)))


@query(f"SELECT t, CAST(least(1600, greatest(400, CAST(round_even(1000 + 200 * {_NORMAL}, 0) AS BIGINT))) AS BIGINT) AS n_requests FROM ticks")
def request_volume(spark, sf_dir):
    ticks = events(spark, sf_dir).select("t").distinct()
    long = lambda n: F.lit(n).cast("long")
    return ticks.select("t", workload.volume(_gauss(F.col("t")), long(1000), long(200), long(400), long(1600)).alias("n_requests"))


_REQ = ", req AS (SELECT t, count(*) AS n_requests FROM ev GROUP BY t)"


def _requests(spark, sf_dir):
    return events(spark, sf_dir).groupBy("t").agg(F.count(F.lit(1)).alias("n_requests"))


@query(_REQ + " SELECT t, n_requests, CAST(sum(n_requests) OVER (ORDER BY t) - n_requests + 1 AS BIGINT) AS first_qid, CAST(sum(n_requests) OVER (ORDER BY t) AS BIGINT) AS last_qid FROM req")
def qid_ranges(spark, sf_dir):
    return workload.query_ids(_requests(spark, sf_dir))


@query(_REQ + ", ids AS (SELECT t, sum(n_requests) OVER (ORDER BY t) AS upto, n_requests FROM req) SELECT t, CAST(unnest(range(CAST(upto - n_requests + 1 AS BIGINT), CAST(upto + 1 AS BIGINT))) AS BIGINT) AS qid FROM ids")
def query_rows(spark, sf_dir):
    return workload.queries(_requests(spark, sf_dir))


@query(f""", q AS (SELECT CAST(event_id + 1 AS BIGINT) AS qid FROM ev), e AS (SELECT DISTINCT (qid - 1) // 100 AS epoch FROM q),
r AS (SELECT epoch, k, row_number() OVER (PARTITION BY epoch ORDER BY {u('k', 'epoch')}, k) AS n FROM e CROSS JOIN keys),
h AS (SELECT epoch, CAST(to_json(list(k ORDER BY k)) AS VARCHAR) AS hot FROM r WHERE n <= 3 GROUP BY epoch)
SELECT qid, epoch, (qid - 1) % 100 < 30 AS active, CASE WHEN (qid - 1) % 100 < 30 THEN hot ELSE '[]' END AS hot FROM q JOIN h ON h.epoch = (qid - 1) // 100""")
def spike_hotset(spark, sf_dir):
    out = workload.spikes(events(spark, sf_dir).select((F.col("event_id") + 1).alias("qid")), 20, 100, 30, 3)
    return out.withColumn("hot", F.to_json("hot"))


_BURSTS = f", bursts AS (SELECT CAST(s_suppkey AS INTEGER) AS burst_id, CAST(greatest(1, least(60, greatest(5, CAST(round_even(30 + 10 * {_NORMAL.replace('CAST(t ', 'CAST(s_suppkey ')}, 0) AS BIGINT)))) AS BIGINT) AS burst_len FROM supplier)"


def _bursts(spark, sf_dir):
    """A burst for each supplier."""
    ids = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("burst_id"))
    return ids.select("burst_id", workload.burst_length(_gauss(F.col("burst_id")), 30.0, 10.0, 5, 60).cast("long").alias("burst_len"))


@query(_BURSTS + " SELECT burst_id, burst_len FROM bursts")
def burst_lengths(spark, sf_dir):
    return _bursts(spark, sf_dir)


@query(_BURSTS + """, upto AS (SELECT *, sum(burst_len) OVER (ORDER BY burst_id) AS last_t FROM bursts), tick AS (SELECT burst_id, burst_len, last_t, unnest(range(CAST(last_t - burst_len + 1 AS BIGINT), CAST(last_t + 1 AS BIGINT))) AS t FROM upto)
SELECT CAST(t AS BIGINT) AS t, burst_id, CAST(t = last_t - burst_len + 1 AS INTEGER) AS burst_start, burst_len, CAST(last_t - t + 1 AS BIGINT) AS burst_remaining FROM tick""")
def burst_timeline(spark, sf_dir):
    return workload.burst_ticks(_bursts(spark, sf_dir))


@query(_BURSTS + f" SELECT burst_id, burst_len, CASE WHEN {u('burst_id', '5')} < 0.3 THEN 'alt' ELSE 'primary' END AS burst_mode FROM bursts")
def burst_modes(spark, sf_dir):
    return workload.burst_modes(_bursts(spark, sf_dir), uniform(F.col("burst_id"), F.lit(5)) < 0.3)


_HOTSET = _BURSTS + f", hot AS (SELECT burst_id, k, row_number() OVER (PARTITION BY burst_id ORDER BY {u('k', 'burst_id')}, k) AS place FROM bursts CROSS JOIN keys), weighted_hot AS (SELECT burst_id, k, place, power(CAST(place AS DOUBLE), CAST(-1.2 AS DOUBLE)) AS w FROM hot WHERE place <= 4)"


@query(_HOTSET + " SELECT burst_id, k, CAST(place AS INTEGER) AS place, round(w / sum(w) OVER (PARTITION BY burst_id), 6) AS weight FROM weighted_hot")
def burst_hot_weights(spark, sf_dir):
    from pyspark.sql import Window

    keyed = _bursts(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19))))
    place = F.row_number().over(Window.partitionBy("burst_id").orderBy(uniform(F.col("k"), F.col("burst_id")), "k"))
    ranked = keyed.withColumn("place", place).where("place <= 4").select("burst_id", "k", "place")
    return workload.hot_weights(ranked, 1.2)


@query(f""", s AS (SELECT t, CAST({u('t', '9')} < 0.05 AS INTEGER) AS dist_switch FROM ticks), d AS (SELECT t, dist_switch, CAST(sum(dist_switch) OVER (ORDER BY t) AS INTEGER) AS dist_id FROM s)
SELECT t, dist_switch, dist_id, CASE WHEN dist_id % 2 = 0 THEN 'zipf' ELSE 'uniform' END AS dist_mode FROM d""")
def dist_mode_timeline(spark, sf_dir):
    ticks = events(spark, sf_dir).select("t").distinct()
    return workload.distribution_modes(ticks.select("t", (uniform(F.col("t"), F.lit(9)) < 0.05).cast("int").alias("dist_switch")))


@query("SELECT t, '[' || CAST(t % 20 AS VARCHAR) || (CASE WHEN t % 20 = 3 THEN '' ELSE ',3' END) || ']' AS hot FROM ticks")
def clean_hot_set(spark, sf_dir):
    ticks = events(spark, sf_dir).select("t").distinct()
    raw = F.array((F.col("t") % 20).cast("string"), F.lit("3"), F.lit("99"), F.lit("x"), (F.col("t") % 20).cast("string"), F.lit("-1"))
    return ticks.select("t", F.to_json(planner.clean_hot(raw, 20)).alias("hot"))


@query("SELECT t, CAST('[7,' || (CASE WHEN t % 20 = 7 THEN '0,1' WHEN t % 20 = 0 THEN '0,1' ELSE CAST(t % 20 AS VARCHAR) || ',0' END) || ']' AS VARCHAR) AS hot FROM ticks")
def fixed_hot_set(spark, sf_dir):
    ticks = events(spark, sf_dir).select("t").distinct()
    ids = F.array(F.lit(7), (F.col("t") % 20).cast("int"), F.lit(7), F.lit(50))
    return ticks.select("t", F.to_json(workload.fixed_hot(ids, 20, 3)).alias("hot"))


@query(_REQ + " SELECT t, CAST(least(n_requests * 20, CAST(round_even(0.8::DOUBLE * (n_requests * 20), 0) AS BIGINT)) AS BIGINT) AS n_hot, CAST(n_requests * 20 - CAST(round_even(0.8::DOUBLE * (n_requests * 20), 0) AS BIGINT) AS BIGINT) AS n_cold FROM req")
def hot_cold_split(spark, sf_dir):
    hot, cold = planner.hot_cold_split(F.col("n_requests") * 20, F.lit(0.8), F.lit(2))
    return _requests(spark, sf_dir).select("t", hot.alias("n_hot"), cold.alias("n_cold"))


@query("SELECT t, CAST(greatest(1, 2 + t % 9 - 4) AS INTEGER) AS nprobe FROM ticks")
def jittered_probes(spark, sf_dir):
    return events(spark, sf_dir).select("t").distinct().select("t", planner.probes(2, (F.col("t") % 9 - 4).cast("int")).alias("nprobe"))


_SOME = ", tk AS (SELECT t, k, n_requests, cost FROM (SELECT t, count(*) AS n_requests FROM ev GROUP BY t) JOIN (SELECT t, k, sum(cost) AS cost FROM ev GROUP BY t, k) USING (t))"


def _tick_keys(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.groupBy("t", "k").agg(F.sum("cost").alias("cost")).join(ev.groupBy("t").agg(F.count(F.lit(1)).alias("n_requests")), "t")


@query(_SOME + " SELECT t, k, CAST(n_requests * 7 // count(*) OVER p + CASE WHEN row_number() OVER o <= n_requests * 7 % count(*) OVER p THEN 1 ELSE 0 END AS BIGINT) AS cnt FROM tk WINDOW p AS (PARTITION BY t), o AS (PARTITION BY t ORDER BY k)")
def even_split(spark, sf_dir):
    return planner.even_split(_tick_keys(spark, sf_dir), F.col("n_requests") * 7, by=("t",)).select("t", "k", "cnt")


@query("SELECT k, CAST(1000 // 20 AS BIGINT) AS cnt FROM keys")
def uniform_counts(spark, sf_dir):
    return planner.even_split(bound(spark, sf_dir).keys, F.lit(1000)).select("k", "cnt")


def _apportioned(source: str, n: str, prob: str, by: str = "t") -> str:
    """CTEs of largest remainders."""
    return f""", want AS (SELECT *, {n} * {prob} AS expected, {n} AS total FROM {source}),
    fl AS (SELECT *, floor(round(expected, 9)) AS fl, round(expected - floor(round(expected, 9)), 9) AS frac FROM want),
    app AS (SELECT *, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY frac DESC, k) <= total - sum(fl) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS BIGINT) AS cnt FROM fl)"""


@query(_SOME + ", pr AS (SELECT *, cost / sum(cost) OVER (PARTITION BY t) AS prob FROM tk)" + _apportioned("pr", "(n_requests * 20)", "prob") + " SELECT t, k, cnt FROM app")
def largest_remainder(spark, sf_dir):
    items = planner.normalized(_tick_keys(spark, sf_dir), "cost", by=("t",))
    return planner.apportion(items, F.col("n_requests") * 20, by=("t",)).select("t", "k", "cnt")


@query(
    "WITH it AS (SELECT c_custkey AS k, greatest(c_acctbal, 0) / sum(greatest(c_acctbal, 0)) OVER () AS prob, 1 AS one FROM customer)" + _apportioned("it", "(SELECT count(*) FROM orders)", "prob", "one").replace("sum(fl) OVER (PARTITION BY one)", "sum(fl) OVER ()") + " SELECT k, cnt FROM app",
    with_prelude=False,
)
def orders_apportioned(spark, sf_dir):
    """As many shares as there are orders, over all customers by their balance: one group that no task sorts."""
    balance = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("weight"))
    total, n = balance.agg(F.sum("weight").alias("total")), read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"))
    items = balance.join(F.broadcast(total), F.lit(True)).join(F.broadcast(n), F.lit(True)).select("k", (F.col("weight") / F.col("total")).alias("prob"), "n")
    return planner.apportion_large(items, F.col("n")).select("k", "cnt")


@query(_ZIPF + _apportioned("(SELECT *, 1 AS one FROM zipf)", "12345", "prob", "one") + " SELECT k, cnt FROM app")
def zipf_counts(spark, sf_dir):
    return planner.apportion(_zipf(spark, sf_dir), F.lit(12345)).select("k", "cnt")


@query(_ZIPF + ", cold AS (SELECT t, k, prob / sum(prob) OVER (PARTITION BY t) AS prob FROM ticks CROSS JOIN zipf WHERE k NOT IN (t % 20, (t + 7) % 20)) SELECT t, k, round(prob, 6) AS prob FROM cold")
def cold_pool(spark, sf_dir):
    ticks = events(spark, sf_dir).select("t").distinct()
    return planner.cold_pool(_zipf(spark, sf_dir), _hot(ticks), ticks).select("t", "k", "prob")


def _hot(ticks):
    """Two hot keys a tick with weights 1 and 2 ** -1.2."""
    both = F.array(F.struct((F.col("t") % 20).cast("int").alias("k"), F.lit(1.0).alias("weight")), F.struct(((F.col("t") + 7) % 20).cast("int").alias("k"), F.lit(2.0**-1.2).alias("weight")))
    return ticks.select("t", F.explode(both).alias("h")).select("t", "h.k", "h.weight")


_PLAN = (
    _ZIPF
    + _REQ
    + """, target AS (SELECT t, n_requests * 20 AS target, CAST(round_even(0.8::DOUBLE * (n_requests * 20), 0) AS BIGINT) AS to_hot, CASE WHEN t // 24 % 2 = 0 THEN 'zipf' ELSE 'uniform' END AS mode FROM req),
hotw AS (SELECT t, t % 20 AS k, CAST(1 AS DOUBLE) AS w FROM ticks UNION ALL SELECT t, (t + 7) % 20, power(CAST(2 AS DOUBLE), CAST(-1.2 AS DOUBLE)) FROM ticks),
pool AS (SELECT t, k, 'hot' AS part, w AS w FROM hotw UNION ALL SELECT t, k, 'cold', CASE WHEN t // 24 % 2 = 0 THEN prob ELSE 1 END FROM ticks CROSS JOIN zipf WHERE k NOT IN (t % 20, (t + 7) % 20)),
pr AS (SELECT t, k, part, t * 2 + CAST(part = 'hot' AS INTEGER) AS grp, w / sum(w) OVER (PARTITION BY t, part) AS prob, CASE WHEN part = 'hot' THEN to_hot ELSE target - to_hot END AS n FROM pool JOIN target USING (t))"""
    + _apportioned("pr", "n", "prob", "grp")
    + ", plan AS (SELECT t, k, cnt FROM app WHERE cnt > 0)"
)


def _counts(spark, sf_dir):
    requests = _requests(spark, sf_dir).withColumn("hot_mass", F.lit(0.8)).withColumn("dist_mode", F.when(F.floor(F.col("t") / 24) % 2 == 0, "zipf").otherwise("uniform"))
    return planner.plan_counts(requests, _zipf(spark, sf_dir), _hot(requests.select("t")), 20)


@query(_PLAN + " SELECT t, k, cnt FROM plan")
def plan_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(_PLAN + " SELECT t, k, round(cnt * (CAST(1 AS DOUBLE) + k % 3), 6) AS cost FROM plan")
def plan_cost(spark, sf_dir):
    costs = bound(spark, sf_dir).keys.select("k", (F.lit(1.0) + F.col("k") % 3).alias("cost"))
    return planner.cost_of(_counts(spark, sf_dir), costs)


_CDF = _ZIPF + ", cdf AS (SELECT k, prob, sum(prob) OVER (ORDER BY k) AS upto FROM zipf)"


@query(_CDF + f", d AS (SELECT event_id, {u('event_id', '2')} AS u FROM ev) SELECT event_id, coalesce((SELECT min(k) FROM cdf WHERE d.u <= upto), 19) AS k FROM d")
def inverse_cdf_draw(spark, sf_dir):
    draws = events(spark, sf_dir).select("event_id", uniform(F.col("event_id"), F.lit(2)).alias("u"))
    return planner.inverse_cdf(draws, _zipf(spark, sf_dir)).select("event_id", "k")


@query(_SOME + f", keyed AS (SELECT t, k, row_number() OVER (PARTITION BY t ORDER BY -ln(greatest({u('t', 'k')}, 1e-300)) / cost, k) AS n FROM tk WHERE cost > 0) SELECT t, k, CAST(n AS INTEGER) AS nth FROM keyed WHERE n <= 3")
def weighted_sample_wor(spark, sf_dir):
    items = _tick_keys(spark, sf_dir).withColumnRenamed("cost", "weight")
    return planner.sample_without_replacement(items, 3, uniform(F.col("t"), F.col("k")), by=("t",)).select("t", "k", "nth")


@query(
    """, w AS (SELECT event_id, k, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '-2' WHEN event_id % 5 = 2 THEN 'bad' ELSE CAST(1 + k AS VARCHAR) END AS raw, event_id // 5 AS grp FROM ev),
    n AS (SELECT *, greatest(0, coalesce(TRY_CAST(raw AS DOUBLE), 0)) AS w FROM w)
    SELECT event_id, k, round(CASE WHEN sum(w) OVER p > 1e-12 THEN w / sum(w) OVER p ELSE CAST(1 AS DOUBLE) / count(*) OVER p END, 6) AS prob FROM n WINDOW p AS (PARTITION BY grp)"""
)
def normalized_weights(spark, sf_dir):
    e = events(spark, sf_dir)
    r = F.col("event_id") % 5
    raw = F.when(r == 0, F.lit(None).cast("string")).when(r == 1, "-2").when(r == 2, "bad").otherwise((F.col("k") + 1).cast("string"))
    out = planner.normalized(e.select("event_id", "k", raw.alias("weight"), F.floor(F.col("event_id") / 5).alias("grp")), by=("grp",))
    return out.select("event_id", "k", "prob")


def _plans(spark, sf_dir, repeat):
    e = events(spark, sf_dir)
    requests = e.select("t", F.col("event_id").alias("request"), F.lit(0.8).alias("hot_mass"), F.col("event_id").alias("seed"))
    return planner.request_plans(requests, _zipf(spark, sf_dir), _hot(e.select("t").distinct()), 6, repeat)


@query(
    _ZIPF
    + f""", pool AS (SELECT t, t % 20 AS k, CAST(1 AS DOUBLE) AS w, true AS is_hot FROM ticks UNION ALL SELECT t, (t + 7) % 20, power(CAST(2 AS DOUBLE), CAST(-1.2 AS DOUBLE)), true FROM ticks
    UNION ALL SELECT t, k, prob, false FROM ticks CROSS JOIN zipf WHERE k NOT IN (t % 20, (t + 7) % 20)),
    pp AS (SELECT t, k, is_hot, w / sum(w) OVER (PARTITION BY t, is_hot) AS prob FROM pool),
    keyed AS (SELECT t, event_id AS request, pp.k, is_hot, row_number() OVER (PARTITION BY t, event_id, is_hot ORDER BY -ln(greatest({u('event_id', 'pp.k')}, 1e-9)) / prob, pp.k) AS n FROM ev JOIN pp USING (t))
    SELECT t, request, k, CAST(1 AS BIGINT) AS cnt FROM keyed WHERE n <= CASE WHEN is_hot THEN 2 ELSE 4 END"""
)
def request_plan_no_repeat(spark, sf_dir):
    return _plans(spark, sf_dir, False)


@query(
    _ZIPF
    + f""", pool AS (SELECT t, t % 20 AS k, CAST(1 AS DOUBLE) AS w, true AS is_hot FROM ticks UNION ALL SELECT t, (t + 7) % 20, power(CAST(2 AS DOUBLE), CAST(-1.2 AS DOUBLE)), true FROM ticks
    UNION ALL SELECT t, k, prob, false FROM ticks CROSS JOIN zipf WHERE k NOT IN (t % 20, (t + 7) % 20)),
    pp AS (SELECT t, k, is_hot, w / sum(w) OVER (PARTITION BY t, is_hot) AS prob FROM pool),
    cdf AS (SELECT *, sum(prob) OVER (PARTITION BY t, is_hot ORDER BY k) AS upto FROM pp),
    d AS (SELECT t, event_id AS request, i, i < 5 AS is_hot, {u('event_id', 'i')} AS u FROM (SELECT t, event_id, CAST(unnest(range(6)) AS BIGINT) AS i FROM ev)),
    hit AS (SELECT d.t, request, i, min(cdf.k) AS k FROM d JOIN cdf ON d.t = cdf.t AND d.is_hot = cdf.is_hot AND d.u <= cdf.upto GROUP BY d.t, request, i)
    SELECT t, request, k, count(*) AS cnt FROM hit GROUP BY t, request, k"""
)
def request_plan_repeat(spark, sf_dir):
    return _plans(spark, sf_dir, True)


@query("SELECT event_id, CAST(coalesce(json_extract(props, '$.k'), '0') AS INTEGER) % 20 AS burst_id, CAST(0 AS DOUBLE) AS hot_mass, 'zipf' AS dist_mode, CAST(0 AS INTEGER) AS n_hot FROM ev")
def payload_defaults(spark, sf_dir):
    e = events(spark, sf_dir)
    p = workload.payload(F.regexp_replace("props", '"k"', '"burst_id"'))
    return e.select("event_id", p.alias("p")).select("event_id", (F.col("p.burst_id") % 20).alias("burst_id"), "p.hot_mass", "p.dist_mode", F.size("p.hot").alias("n_hot"))


@query(f"SELECT CAST(qid AS BIGINT) AS qid, i, round({u('qid', 'i')}, 6) AS x FROM (SELECT s_suppkey AS qid FROM supplier) CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(1, 9))")
def vector_payload(spark, sf_dir):
    ids = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"))
    return workload.vectors(ids, 8).select("qid", F.posexplode("vector").alias("i", "x")).select("qid", (F.col("i") + 1).alias("i"), "x")


@query("SELECT event_id, t, first_value(event_id) OVER (PARTITION BY t ORDER BY event_id) AS shared, event_id AS own FROM ev")
def batch_payloads(spark, sf_dir):
    """Every request's payload where a tick's requests share one, and where they do not."""
    requests = events(spark, sf_dir).select("t", F.col("event_id").alias("request"), F.struct("event_id").alias("payload"))
    own = workload.batch(requests, locked=False).select("request", F.col("payload.event_id").alias("own"))
    both = workload.batch(requests).select("t", "request", F.col("payload.event_id").alias("shared")).join(own, "request")
    return both.select(F.col("request").alias("event_id"), "t", "shared", "own")


_SEED = f"{planner.SAMPLE} + CAST(t AS BIGINT) * 1048576 + request"
_SAMPLED = (
    _ZIPF
    + f""", pool AS (SELECT t, t % 20 AS k, CAST(1 AS DOUBLE) AS w, true AS is_hot FROM ticks UNION ALL SELECT t, (t + 7) % 20, power(CAST(2 AS DOUBLE), CAST(-1.2 AS DOUBLE)), true FROM ticks
UNION ALL SELECT t, k, prob, false FROM ticks CROSS JOIN zipf WHERE k NOT IN (t % 20, (t + 7) % 20)),
pp AS (SELECT t, k, is_hot, w / sum(w) OVER (PARTITION BY t, is_hot) AS prob FROM pool),
cdf AS (SELECT *, sum(prob) OVER (PARTITION BY t, is_hot ORDER BY k) AS upto FROM pp),
sq AS (SELECT t, CAST(unnest(range(least(n, 8))) AS INTEGER) AS request FROM (SELECT t, count(*) AS n FROM ev GROUP BY t)),
d AS (SELECT t, request, i, i < 5 AS is_hot, {u('(' + _SEED + ')', 'i')} AS u FROM (SELECT t, request, CAST(unnest(range(6)) AS BIGINT) AS i FROM sq)),
hit AS (SELECT d.t, request, i, min(cdf.k) AS k FROM d JOIN cdf ON d.t = cdf.t AND d.is_hot = cdf.is_hot AND d.u <= cdf.upto GROUP BY d.t, request, i)"""
)


def _sampled(spark, sf_dir):
    ticks = _requests(spark, sf_dir).withColumn("hot_mass", F.lit(0.8))
    return planner.sampled_plans(ticks, _zipf(spark, sf_dir), _hot(ticks.select("t")), 6, 8)


@query(_SAMPLED + ", fan AS (SELECT t, request, CAST(count(DISTINCT server) AS DOUBLE) AS f FROM hit JOIN keymap USING (k) GROUP BY t, request) SELECT t, count(*) AS fanout_req_samples, round(avg(f), 6) AS fanout_req_mean, min(f) AS fanout_req_min, max(f) AS fanout_req_max, round(var_pop(f), 6) AS fanout_req_var FROM fan GROUP BY t")
def fanout_sampled(spark, sf_dir):
    """Fan-out of at most eight further requests of each tick."""
    places = layout.keymap(bound(spark, sf_dir).slices)
    return metrics.fanout_stats(metrics.request_fanouts(_sampled(spark, sf_dir), places))


@query(_SAMPLED + ", n AS (SELECT t, count(*) AS n FROM sq GROUP BY t) SELECT t, k, round(CAST(count(*) AS DOUBLE) / n, 6) AS demand FROM hit JOIN n USING (t) GROUP BY t, k, n")
def demand_sampled(spark, sf_dir):
    return planner.sampled_demand(_sampled(spark, sf_dir))
