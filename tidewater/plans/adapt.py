"""Queries on growth, splits, rebalancing and layout differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numbers import uniform
from ..operators import analysis, diff, growth, layout, rebalance, routing
from .bind import bound, query
from .planning import u


def _total(b):
    """Load of each key over all ticks."""
    return b.work.groupBy("k").agg(F.sum("cost").alias("load"))


def _loaded(b):
    """Slices with their load over all ticks."""
    loads = routing.allocate(b.work.withColumn("t", F.lit(0)), b.slices).groupBy("slice_id").agg(F.sum("load").alias("load"))
    return b.slices.join(loads, "slice_id", "left").na.fill(0.0, ["load"])


_TOTAL = ", total AS (SELECT k, sum(cost) AS load FROM ev GROUP BY k), loaded AS (SELECT slice_id, lo, hi, slices.size, slices.server, coalesce(load * share, 0) AS load FROM slices LEFT JOIN shares USING (slice_id) LEFT JOIN total ON total.k = lo)"


@query("SELECT t, CAST((t - 1) // 50 AS BIGINT) AS epoch, CAST(t % 50 = 0 AS INTEGER) AS rebalance FROM ticks")
def rebalance_ticks(spark, sf_dir):
    t = bound(spark, sf_dir).work.select("t").distinct()
    return t.select("t", F.floor((F.col("t") - 1) / 50).alias("epoch"), (F.col("t") % 50 == 0).cast("int").alias("rebalance"))


@query(", r AS (SELECT t, k, load, row_number() OVER (PARTITION BY t ORDER BY load DESC, k) AS place, count(*) OVER (PARTITION BY t) AS n FROM loads WHERE load > 0) SELECT t, k, round(load, 6) AS load, CAST(place AS INTEGER) AS place FROM r WHERE place <= greatest(1, round_even(n * 0.1::DOUBLE, 0))")
def popular_clusters(spark, sf_dir):
    return growth.popular(routing.cluster_loads(bound(spark, sf_dir).work), 0.1, by=("t",)).select("t", "k", "load", "place")


_GROWTH = (
    _TOTAL
    + """, pop AS (SELECT k, load, row_number() OVER (ORDER BY load DESC, k) AS place FROM total), chosen AS (SELECT * FROM pop WHERE place <= 4),
sh AS (SELECT k, place, load, load / sum(load) OVER () AS load_share, count(*) OVER () AS n FROM chosen),
gr AS (SELECT sh.*, size, size * 0.05::DOUBLE * (0.5::DOUBLE + load_share * n) + 0.1::DOUBLE * greatest(1, 0.5::DOUBLE + load_share * n) AS growth, CAST(least(3, 1 + round_even(2 * least(1, load_share * n), 0)) AS INTEGER) AS parts FROM sh JOIN keys USING (k))"""
)


def _planned(b):
    return growth.plan(growth.popular(_total(b), 0.2, 4), b.keys, 0.05, 0.1, 3)


@query(_GROWTH + " SELECT k, CAST(place AS INTEGER) AS place, round(load, 6) AS load, round(load_share, 6) AS load_share, size AS size_before, round(growth, 6) AS growth, parts FROM gr")
def growth_plan(spark, sf_dir):
    return _planned(bound(spark, sf_dir)).select("k", "place", "load", "load_share", "size_before", "growth", "parts")


@query(
    _GROWTH
    + f""", cut AS (SELECT k, place, growth, CAST(unnest(range(parts)) AS INTEGER) AS part FROM gr), w AS (SELECT *, 0.2::DOUBLE + {u('k', 'part')} AS w FROM cut)
    SELECT k, CAST(70 + row_number() OVER (ORDER BY place, part) AS BIGINT) AS slice_id, CAST((2 + row_number() OVER (ORDER BY place, part)) % 8 AS INTEGER) AS server, part, round(growth * w / sum(w) OVER (PARTITION BY k), 6) AS delta FROM w"""
)
def growth_parts(spark, sf_dir):
    b = bound(spark, sf_dir)
    return growth.parts(_planned(b), F.array(*map(F.lit, range(8))), 3, 71)


@query(_GROWTH + " SELECT k, round(size + coalesce(growth, 0), 6) AS size FROM keys LEFT JOIN (SELECT k, growth FROM gr) USING (k)")
def cluster_sizes_after_growth(spark, sf_dir):
    b = bound(spark, sf_dir)
    added = growth.parts(_planned(b), F.array(*map(F.lit, range(8))), 3, 71).groupBy("k").agg(F.sum("delta").alias("added"))
    return b.keys.join(added, "k", "left").select("k", (F.col("size") + F.coalesce("added", F.lit(0.0))).alias("size"))


@query("SELECT slice_id, server, round(size, 6) AS size_before, round(size + size * 0.1::DOUBLE + 0.01::DOUBLE, 6) AS size_after, round(size * 0.1::DOUBLE + 0.01::DOUBLE, 6) AS delta FROM slices WHERE server IN (1, 4)")
def grow_on_servers(spark, sf_dir):
    b = bound(spark, sf_dir)
    return layout.grow_on(b.slices, b.servers.where("server IN (1, 4)"), 0.1, 0.01)


@query("SELECT slice_id, lo, hi, round(size, 6) AS size, CASE WHEN slice_id % 10 = 0 THEN 7 ELSE server END AS server FROM slices")
def reassign_slices(spark, sf_dir):
    b = bound(spark, sf_dir)
    return layout.reassign(b.slices, b.slices.where("slice_id % 10 = 0").select("slice_id", F.lit(7).alias("to")))


_CHUNKS = ", chunks AS (SELECT CAST(k // 5 + 1 AS BIGINT) AS slice_id, min(k) AS lo, max(k) + 1 AS hi, sum(size) AS size, CAST(k // 5 % 8 AS INTEGER) AS server FROM keys GROUP BY k // 5)"


@query(
    _CHUNKS
    + """, hit AS (SELECT *, row_number() OVER (ORDER BY slice_id) AS n FROM chunks WHERE slice_id IN (2, 4))
    SELECT slice_id, lo, hi, size, server FROM chunks WHERE slice_id NOT IN (2, 4)
    UNION ALL SELECT CAST(4 + 2 * n - 1 AS BIGINT), lo, CAST((lo + hi) // 2 AS INTEGER), size / 2, server FROM hit UNION ALL SELECT CAST(4 + 2 * n AS BIGINT), CAST((lo + hi) // 2 AS INTEGER), hi, size / 2, server FROM hit"""
)
def split_range(spark, sf_dir):
    chunks = layout.chunked(bound(spark, sf_dir).keys, 5, 8)
    return layout.split(chunks, chunks.where("slice_id IN (2, 4)"), F.lit(0.5))


@query(
    _TOTAL
    + f""", hotk AS (SELECT k FROM total ORDER BY load DESC, k LIMIT 3), ranked AS (SELECT loaded.*, row_number() OVER (PARTITION BY lo ORDER BY load DESC, size DESC, slice_id) AS n FROM loaded WHERE lo IN (SELECT k FROM hotk)),
    hit AS (SELECT *, 0.3::DOUBLE + 0.4::DOUBLE * {u('slice_id', '13')} AS r, row_number() OVER (ORDER BY slice_id) AS m FROM ranked WHERE n = 1)
    SELECT slice_id, lo, hi, round(size, 6) AS size, server, round(load, 6) AS load FROM loaded WHERE slice_id NOT IN (SELECT slice_id FROM hit)
    UNION ALL SELECT CAST(70 + 2 * m - 1 AS BIGINT), lo, hi, round(size * r, 6), server, round(load * r, 6) FROM hit UNION ALL SELECT CAST(70 + 2 * m AS BIGINT), lo, hi, round(size - size * r, 6), server, round(load - load * r, 6) FROM hit"""
)
def split_hot(spark, sf_dir):
    b = bound(spark, sf_dir)
    loaded = _loaded(b)
    hot = growth.popular(_total(b), 0.1, 3)
    return layout.split(loaded, layout.hottest_slices(loaded, hot), F.lit(0.3) + 0.4 * uniform(F.col("slice_id"), F.lit(13)))


_PAIRS = _CHUNKS + ", on2 AS (SELECT slice_id, lo, hi, size, CAST(server % 2 AS INTEGER) AS server FROM chunks UNION ALL SELECT slice_id + 100, lo, hi, size, 1 FROM chunks WHERE slice_id <= 2), o AS (SELECT server, slice_id AS a, hi, lo, lead(slice_id) OVER w AS b, lead(lo) OVER w AS blo, lead(hi) OVER w AS bhi FROM on2 WINDOW w AS (PARTITION BY server ORDER BY lo, hi, slice_id)), pairs AS (SELECT server, a, b FROM o WHERE blo = hi OR (blo = lo AND bhi = hi))"


def _two_servers(spark, sf_dir):
    chunks = layout.chunked(bound(spark, sf_dir).keys, 5, 8)
    two = chunks.withColumn("server", (F.col("server") % 2).cast("int"))
    return two.unionByName(two.where("slice_id <= 2").withColumn("slice_id", F.col("slice_id") + 100).withColumn("server", F.lit(1)))


@query(_PAIRS + " SELECT server, a, b FROM pairs")
def mergeable_pairs(spark, sf_dir):
    return layout.mergeable(_two_servers(spark, sf_dir))


@query(_PAIRS + """, m AS (SELECT CAST(1 AS BIGINT) AS n, unnest([2, 102]) AS slice_id) SELECT slice_id, lo, hi, size, server FROM on2 WHERE slice_id NOT IN (2, 102) UNION ALL SELECT CAST(103 AS BIGINT), min(lo), max(hi), sum(size), min(server) FROM on2 JOIN m USING (slice_id)""")
def merge_pairs(spark, sf_dir):
    two = _two_servers(spark, sf_dir)
    return layout.merge(two, layout.mergeable(two).where("a = 2 AND b = 102")).select("slice_id", "lo", "hi", "size", "server")


@query("SELECT CAST(k + 1 AS BIGINT) AS slice_id, k AS lo, k + 1 AS hi, size, server FROM keys JOIN prim USING (k)")
def single_key_layout(spark, sf_dir):
    b = bound(spark, sf_dir)
    return layout.one_per_key(b.keys, layout.primaries(b.slices))


_MOVES = (
    _TOTAL
    + """, sl AS (SELECT server, capacity, coalesce(sum(load), 0) AS load FROM servers LEFT JOIN loaded USING (server) GROUP BY server, capacity), su AS (SELECT *, load / capacity AS util FROM sl),
hot AS (SELECT * FROM su ORDER BY util DESC, server LIMIT 1), cold AS (SELECT * FROM su ORDER BY util, server LIMIT 1),
st AS (SELECT hot.server AS hs, hot.load AS hl, hot.capacity AS hc, cold.server AS cs, cold.load AS cl, cold.capacity AS cc, hot.util AS hu, (SELECT max(util) FROM su WHERE server NOT IN (hot.server, cold.server)) AS rest, (SELECT sum(util) FROM su) AS total FROM hot CROSS JOIN cold),
mv AS (SELECT slice_id, server AS "from", cs AS "to", size AS churn, hu / (total / 8) AS before, greatest(rest, (hl - load) / hc, (cl + load) / cc) / ((total - load / hc + load / cc) / 8) AS after FROM loaded JOIN st ON server = hs WHERE load > 0 AND size > 0),
better AS (SELECT *, (before - after) / churn AS weight FROM mv WHERE after < before)"""
)
_MOVE_COLUMNS = 'slice_id, "from", "to", round(churn, 6) AS churn, round(before, 6) AS before, round(after, 6) AS after, round(weight, 6) AS weight'


@query(_MOVES + f" SELECT {_MOVE_COLUMNS} FROM better")
def greedy_candidates(spark, sf_dir):
    b = bound(spark, sf_dir)
    return rebalance.candidates(_loaded(b), b.servers)


@query(_MOVES + f" SELECT {_MOVE_COLUMNS} FROM better ORDER BY better.weight DESC, slice_id LIMIT 1")
def greedy_best_move(spark, sf_dir):
    b = bound(spark, sf_dir)
    return rebalance.best_move(_loaded(b), b.servers)


def _epochs(b):
    """A scenario for each 100 ticks: the slices with their loads in them."""
    at = b.work.withColumn("t", F.floor((F.col("t") - 1) / 100).cast("int"))
    return routing.slice_loads(at, b.slices).withColumnRenamed("t", "scenario").withColumn("scenario", F.col("scenario").cast("long")).join(b.slices.select("slice_id", "size"), "slice_id")


_EPOCHS = """, sc AS (SELECT DISTINCT CAST((t - 1) // 100 AS BIGINT) AS scenario FROM ev), kl AS (SELECT CAST((t - 1) // 100 AS BIGINT) AS scenario, k, sum(cost) AS load FROM ev GROUP BY 1, 2),
sl AS (SELECT sc.scenario, s.slice_id, s.size, s.server, coalesce(kl.load * shares.share, 0) AS load FROM sc CROSS JOIN slices s JOIN shares ON shares.slice_id = s.slice_id LEFT JOIN kl ON kl.scenario = sc.scenario AND kl.k = s.lo),
start AS (SELECT scenario, list(slice_id ORDER BY slice_id) AS ids, list(size ORDER BY slice_id) AS size, list(load ORDER BY slice_id) AS load, list(server ORDER BY slice_id) AS srv FROM sl GROUP BY scenario)"""


def _on(srv: str) -> str:
    """Utilisations of the eight servers."""
    return f"[list_sum([CASE WHEN {srv}[i] = s THEN load[i] ELSE 0 END FOR i IN range(1, len(ids) + 1)]) / caps[s + 1] FOR s IN range(8)]"


_GREEDY = _EPOCHS + f""", run AS (
  SELECT scenario, 0 AS step, ids, size, load, srv, CAST(0 AS DOUBLE) AS used, CAST(NULL AS BIGINT) AS slice_id, CAST(NULL AS INTEGER) AS "from", CAST(NULL AS INTEGER) AS "to", CAST(NULL AS DOUBLE) AS churn, CAST(NULL AS DOUBLE) AS imbalance_before, CAST(NULL AS DOUBLE) AS imbalance_after FROM start
  UNION ALL
  SELECT scenario, step + 1, ids, size, load, moved, used + size[best], ids[best], CAST(hot - 1 AS INTEGER), CAST(cold - 1 AS INTEGER), size[best], util[hot] / (total / 8), list_max(after_util) / (list_sum(after_util) / 8)
  FROM (SELECT *, {_on("moved")} AS after_util FROM (SELECT *, [CASE WHEN i = best THEN CAST(cold - 1 AS INTEGER) ELSE srv[i] END FOR i IN range(1, len(ids) + 1)] AS moved FROM (
    SELECT *, list_position(gains, list_max(gains)) AS best FROM (
      SELECT *, [CASE WHEN srv[i] = hot - 1 AND size[i] > 0 AND load[i] > 0 THEN (util[hot] / (total / 8) - greatest(greatest(util[hot] * caps[hot] - load[i], 0) / caps[hot], (util[cold] * caps[cold] + load[i]) / caps[cold], rest) / ((total - load[i] / caps[hot] + load[i] / caps[cold]) / 8)) / size[i] ELSE CAST('-inf' AS DOUBLE) END FOR i IN range(1, len(ids) + 1)] AS gains FROM (
        SELECT *, coalesce(list_max([CASE WHEN j <> hot AND j <> cold THEN util[j] END FOR j IN range(1, 9)]), 0) AS rest FROM (
          SELECT *, list_sum(util) AS total, list_position(util, list_max(util)) AS hot, list_position(util, list_min(util)) AS cold FROM (
            SELECT *, {_on("srv")} AS util FROM (SELECT *, [40.0 + s % 3 * 5 FOR s IN range(8)]::DOUBLE[] AS caps FROM run)))
        WHERE hot <> cold AND total > 1e-12)))
    WHERE gains[best] > 0 AND used < 5 AND used + size[best] <= 5)))
SELECT scenario, CAST(step AS INTEGER) AS step, slice_id, "from", "to", round(churn, 6) AS churn, round(imbalance_before, 6) AS imbalance_before, round(imbalance_after, 6) AS imbalance_after FROM run WHERE step > 0"""
_CAPACITY = {s: 40.0 + s % 3 * 5 for s in range(8)}


@query(_GREEDY, recursive=True)
def greedy_run(spark, sf_dir):
    return rebalance.greedy(_epochs(bound(spark, sf_dir)), _CAPACITY, 5.0)


@query(_GREEDY, recursive=True)
def greedy_recursion(spark, sf_dir):
    """The same log by a recursive query."""
    return rebalance.greedy_recursive(_epochs(bound(spark, sf_dir)), _CAPACITY, 5.0)


@query()
def min_max_assignment(spark, sf_dir):
    b = bound(spark, sf_dir)
    at = b.work.withColumn("scenario", F.floor((F.col("t") - 1) / 100)).groupBy("scenario", "k").agg(F.sum("cost").alias("load"))
    return rebalance.min_max(at.join(b.keys, "k").join(layout.primaries(b.slices), "k").select("scenario", "k", "size", "load", "server"), list(_CAPACITY.values()), 6)


@query(""", l AS (SELECT CAST((t - 1) // 100 AS BIGINT) AS scenario, k, sum(cost) AS load FROM ev GROUP BY 1, 2), p AS (SELECT scenario, k, load, server FROM l JOIN prim USING (k)),
r AS (SELECT scenario, sum(load) AS rest FROM p GROUP BY scenario, server UNION ALL SELECT scenario, sum(load) OVER (PARTITION BY scenario, server) - sum(load) OVER (PARTITION BY scenario, server ORDER BY load DESC, k) FROM p),
n AS (SELECT scenario, rest, row_number() OVER (PARTITION BY scenario ORDER BY rest DESC) AS n FROM r), b AS (SELECT scenario, greatest(max(load), sum(load) / 8) AS bound FROM l GROUP BY scenario)
SELECT scenario, round(greatest(bound, coalesce(rest, 0)), 6) AS bound, true AS above FROM b LEFT JOIN (SELECT * FROM n WHERE n = 7) USING (scenario)""")
def min_max_bound(spark, sf_dir):
    """The bound of six moves that certifies each scenario's assignment."""
    per = min_max_assignment(spark, sf_dir).groupBy("scenario").agg(F.first("bound").alias("bound"), F.first("peak").alias("peak"))
    return per.select("scenario", "bound", (F.col("peak") >= F.col("bound") - 1e-9).alias("above"))


@query("SELECT scenario, 0 AS unassigned, 0 AS over_capacity, true AS within_moves FROM (SELECT DISTINCT CAST((t - 1) // 100 AS BIGINT) AS scenario FROM ev)")
def min_max_feasibility(spark, sf_dir):
    b = bound(spark, sf_dir)
    got = min_max_assignment(spark, sf_dir).join(b.keys, "k")
    want = b.work.select(F.floor((F.col("t") - 1) / 100).alias("scenario"), "k").distinct().groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    per = got.join(b.servers, "server").groupBy("scenario", "server", "capacity").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"), F.sum(F.col("moved").cast("int")).alias("moves"))
    per = per.groupBy("scenario").agg(F.sum("n").alias("assigned"), F.sum((F.col("held") > F.col("capacity")).cast("int")).cast("int").alias("over_capacity"), (F.sum("moves") <= 6).alias("within_moves"))
    return per.join(want, "scenario").select("scenario", (F.col("n") - F.col("assigned")).cast("int").alias("unassigned"), "over_capacity", "within_moves")


_AFTER = ", aft AS (SELECT slice_id, lo, hi, size, CAST(CASE WHEN slice_id % 9 = 4 THEN (server + 1) % 8 ELSE server END AS INTEGER) AS server FROM slices WHERE slice_id % 11 <> 5 UNION ALL SELECT slice_id + 100, lo, hi, size * 3, CAST((server + 3) % 8 AS INTEGER) FROM slices WHERE slice_id % 13 = 6)"


def _before_after(spark, sf_dir):
    b = bound(spark, sf_dir).slices
    moved = F.when(F.col("slice_id") % 9 == 4, (F.col("server") + 1) % 8).otherwise(F.col("server")).cast("int")
    old = b.where("slice_id % 11 <> 5").withColumn("server", moved)
    new = b.where("slice_id % 13 = 6").select((F.col("slice_id") + 100).alias("slice_id"), "lo", "hi", (F.col("size") * 3).alias("size"), ((F.col("server") + 3) % 8).cast("int").alias("server"))
    return b, old.unionByName(new)


@query(_AFTER + " SELECT 'added' AS kind, slice_id, lo, hi, round(size, 6) AS size, server FROM aft WHERE slice_id NOT IN (SELECT slice_id FROM slices) UNION ALL SELECT 'removed', slice_id, lo, hi, round(size, 6), server FROM slices WHERE slice_id NOT IN (SELECT slice_id FROM aft)")
def diff_added_removed(spark, sf_dir):
    return diff.added_removed(*_before_after(spark, sf_dir))


@query(_AFTER + ' SELECT slice_id, slices.server AS "from", aft.server AS "to" FROM slices JOIN aft USING (slice_id) WHERE slices.server <> aft.server')
def diff_moved(spark, sf_dir):
    return diff.moved(*_before_after(spark, sf_dir))


_SNAPS = _AFTER + ", ka AS (SELECT lo AS k, slice_id, server, size, row_number() OVER (PARTITION BY lo ORDER BY size DESC, slice_id) AS nth FROM aft)"


@query(_SNAPS + ' SELECT k, keymap.server AS "from", ka.server AS "to" FROM keymap JOIN ka USING (k) WHERE keymap.nth = 1 AND ka.nth = 1 AND keymap.server <> ka.server')
def diff_key_migrations(spark, sf_dir):
    return diff.key_migrations(*_before_after(spark, sf_dir))


_TRANS = _SNAPS + ", s1 AS (SELECT k AS cluster, list(slice_id ORDER BY nth) AS a, list(server ORDER BY nth) AS b, list(size ORDER BY nth) AS c FROM keymap GROUP BY k), s2 AS (SELECT k AS cluster, list(slice_id ORDER BY nth) AS a, list(server ORDER BY nth) AS b, list(size ORDER BY nth) AS c FROM ka GROUP BY k), tr AS (SELECT cluster, s1.a AS a1, s2.a AS a2, s1.b AS b1, s2.b AS b2 FROM s1 FULL JOIN s2 USING (cluster) WHERE s1.a IS DISTINCT FROM s2.a OR s1.b IS DISTINCT FROM s2.b OR s1.c IS DISTINCT FROM s2.c)"


@query(_TRANS + " SELECT cluster, CAST(to_json(a1) AS VARCHAR) AS slices_before, CAST(to_json(a2) AS VARCHAR) AS slices_after, CAST(to_json(b1) AS VARCHAR) AS servers_before, CAST(to_json(b2) AS VARCHAR) AS servers_after FROM tr")
def diff_cluster_transitions(spark, sf_dir):
    out = diff.transitions(*_before_after(spark, sf_dir))
    return out.select("cluster", *[F.to_json(c).alias(c) for c in ("slices_before", "slices_after", "servers_before", "servers_after")])


@query(_TRANS + """ SELECT 'added' AS kind, count(*) AS n FROM aft WHERE slice_id NOT IN (SELECT slice_id FROM slices) UNION ALL SELECT 'removed', count(*) FROM slices WHERE slice_id NOT IN (SELECT slice_id FROM aft)
UNION ALL SELECT 'moved', count(*) FROM slices JOIN aft USING (slice_id) WHERE slices.server <> aft.server UNION ALL SELECT 'key_migration', count(*) FROM keymap JOIN ka USING (k) WHERE keymap.nth = 1 AND ka.nth = 1 AND keymap.server <> ka.server UNION ALL SELECT 'cluster_transition', count(*) FROM tr""")
def diff_counts(spark, sf_dir):
    return diff.counts(*_before_after(spark, sf_dir))


@query(_TRANS + """, n AS (SELECT (SELECT count(*) FROM aft WHERE slice_id NOT IN (SELECT slice_id FROM slices)) AS added, (SELECT count(*) FROM slices WHERE slice_id NOT IN (SELECT slice_id FROM aft)) AS removed,
(SELECT list(slice_id ORDER BY slice_id)::VARCHAR FROM slices JOIN aft USING (slice_id) WHERE slices.server <> aft.server) AS moved, (SELECT list(k ORDER BY k)::VARCHAR FROM keymap JOIN ka USING (k) WHERE keymap.nth = 1 AND ka.nth = 1 AND keymap.server <> ka.server) AS keys_, (SELECT list(cluster ORDER BY cluster)::VARCHAR FROM tr) AS clusters)
SELECT CAST(added AS INTEGER) AS added, CAST(removed AS INTEGER) AS removed, moved, keys_ AS migrated, clusters FROM n""")
def diff_whole(spark, sf_dir):
    """The five differences as one row of arrays: how many slices came and went, and which moved, migrated and changed."""
    text = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))
    out = diff.whole(*_before_after(spark, sf_dir))
    return out.select(F.size("slice_added").alias("added"), F.size("slice_removed").alias("removed"), text("slice_moved.slice_id").alias("moved"), text("key_migrations.key").alias("migrated"), text("cluster_transitions.cluster").alias("clusters"))


@query(""", l AS (SELECT CAST((t - 1) // 100 AS BIGINT) AS scenario, k, sum(cost) AS load FROM ev WHERE k < 5 GROUP BY 1, 2),
p AS (SELECT scenario, list(load ORDER BY k) AS l FROM l GROUP BY scenario HAVING count(*) = 5), now AS (SELECT list(server % 3 ORDER BY k) AS s FROM prim WHERE k < 5),
r AS (SELECT range AS n, [range % 3, range // 3 % 3, range // 9 % 3, range // 27 % 3, range // 81] AS s FROM range(243)),
tried AS (SELECT scenario, greatest(list_sum([CASE WHEN r.s[i] = 0 THEN l[i] ELSE 0 END FOR i IN [1,2,3,4,5]]), list_sum([CASE WHEN r.s[i] = 1 THEN l[i] ELSE 0 END FOR i IN [1,2,3,4,5]]), list_sum([CASE WHEN r.s[i] = 2 THEN l[i] ELSE 0 END FOR i IN [1,2,3,4,5]])) AS peak FROM p, r, now WHERE list_sum([CAST(r.s[i] <> now.s[i] AS INTEGER) FOR i IN [1,2,3,4,5]]) <= 2)
SELECT scenario, round(min(peak), 6) AS peak FROM tried GROUP BY scenario""")
def min_max_optimum(spark, sf_dir):
    """Five keys on three servers with at most two moves: the least peak of all assignments."""
    b = bound(spark, sf_dir)
    at = b.work.where("k < 5").withColumn("scenario", F.floor((F.col("t") - 1) / 100)).groupBy("scenario", "k").agg(F.sum("cost").alias("load"))
    full = at.groupBy("scenario").count().where("count = 5").select("scenario")
    placed = layout.primaries(b.slices).select("k", (F.col("server") % 3).cast("int").alias("server"))
    got = rebalance.min_max(at.join(full, "scenario").join(b.keys, "k").join(placed, "k").select("scenario", "k", "size", "load", "server"), [40.0, 45.0, 50.0], 2)
    return got.groupBy("scenario").agg(F.max("peak").alias("peak"))


@query(""", l AS (SELECT CAST((t - 1) // 100 AS BIGINT) AS scenario, k, sum(cost) AS load FROM ev GROUP BY 1, 2), p AS (SELECT scenario, k, load, server FROM l JOIN prim USING (k)),
per AS (SELECT scenario, server, sum(load) AS load FROM p GROUP BY scenario, server)
SELECT scenario, 'stay' AS name, CAST(0 AS INTEGER) AS moves, CAST(50 AS DOUBLE) AS room, round(max(load), 6) AS peak, CAST(NULL AS VARCHAR) AS error FROM per GROUP BY scenario
UNION ALL SELECT scenario, 'full', CAST(9 AS INTEGER), CAST(0.5 AS DOUBLE), NULL, 'ValueError: no feasible assignment known: a server is over capacity and its keys fit nowhere' FROM per GROUP BY scenario""")
def sweep_errors(spark, sf_dir):
    """A sweep of two configurations over all scenarios, one of which cannot be met: its runs are rows with their error."""
    b = bound(spark, sf_dir)
    at = b.work.withColumn("scenario", F.floor((F.col("t") - 1) / 100)).groupBy("scenario", "k").agg(F.sum("cost").alias("load"))
    groups = at.join(b.keys, "k").join(layout.primaries(b.slices), "k").select("scenario", "k", "size", "load", "server")
    configs = spark.createDataFrame([("stay", 0, 50.0), ("full", 9, 0.5)], "name string, moves int, room double")

    def run(pdf, config):
        load = pdf["load"].to_numpy(float)
        to = rebalance.assign(pdf["size"].to_numpy(float), load, pdf["server"].to_numpy(int), np.full(8, float(config["room"])), int(config["moves"]))
        return {"peak": float(np.bincount(to, weights=load).max())}

    return analysis.sweep(groups, configs, ("scenario",), run, "peak double")
