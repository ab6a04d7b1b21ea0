"""Queries of joins on ranges, of scans over whole tables in order, of alias tables and of layouts over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import uniform
from ..operators import alias, intervals, layout, ordered, versions
from .bind import events, query, read
from .planning import u

# ---- joins on ranges: of part keys, cut at the parts of size 7

_PART_RANGES = """WITH cuts AS (SELECT DISTINCT p_partkey AS lo FROM part WHERE p_size = 7 UNION SELECT 0),
ranges AS (SELECT row_number() OVER (ORDER BY lo) AS slice_id, lo, coalesce(lead(lo) OVER (ORDER BY lo), (SELECT max(p_partkey) + 1 FROM part)) AS hi FROM cuts)"""


def _part_ranges(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    return layout.cut(parts.where("p_size = 7").select(F.col("p_partkey").alias("cut")), parts.agg((F.max("p_partkey") + 1).alias("end")))


@query(_PART_RANGES + " SELECT slice_id, lo, hi, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN ranges ON l_partkey >= lo AND l_partkey < hi GROUP BY slice_id, lo, hi", with_prelude=False)
def line_items_by_part_range(spark, sf_dir):
    found = intervals.point_join(read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), _part_ranges(spark, sf_dir), "l_partkey")
    return found.groupBy("slice_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


_SPANS = ", spans AS (SELECT p_brand, p_size, min(p_partkey) AS b_lo, max(p_partkey) + 1 AS b_hi FROM part GROUP BY p_brand, p_size)"


@query(_PART_RANGES + _SPANS + " SELECT p_brand, p_size, count(*) AS n, min(slice_id) AS first, max(slice_id) AS last FROM spans JOIN ranges ON greatest(lo, b_lo) < least(hi, b_hi) GROUP BY p_brand, p_size", with_prelude=False)
def ranges_of_brand(spark, sf_dir):
    """Spans of keys of brands and sizes, wide and narrow ones, against the ranges."""
    spans = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("b_lo"), (F.max("p_partkey") + 1).alias("b_hi"))
    found = intervals.overlap_join(spans, _part_ranges(spark, sf_dir), ("b_lo", "b_hi"), ("lo", "hi"))
    return found.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.min("slice_id").alias("first"), F.max("slice_id").alias("last"))


@query(_PART_RANGES + " SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN ranges ON l_partkey >= lo AND l_partkey < hi AND slice_id % 3 <> 0)", with_prelude=False)
def part_keys_without_range(spark, sf_dir):
    return intervals.missed(read(spark, sf_dir, "lineitem"), _part_ranges(spark, sf_dir).where("slice_id % 3 <> 0"), "l_partkey")


# ---- scans in one order

_LINES = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _line_items(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(*_LINES.split(", "))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY {_LINES}) AS id FROM lineitem", with_prelude=False)
def line_item_ids(spark, sf_dir):
    """All line items, numbered in the order of their dates."""
    return ordered.numbered(_line_items(spark, sf_dir), _LINES.split(", "), "id").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "id")


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(f"SELECT l_orderkey, l_linenumber, {_CENTS} AS cents, CAST(sum({_CENTS}) OVER (ORDER BY {_LINES} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum({_CENTS}) OVER (PARTITION BY l_suppkey ORDER BY {_LINES} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS of_supplier FROM lineitem", with_prelude=False)
def line_item_running_total(spark, sf_dir):
    """Running totals of all line items, and of each supplier's."""
    cents = _line_items(spark, sf_dir).withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    whole = ordered.scanned(cents, _LINES.split(", "), {"upto": F.col("cents")})
    return ordered.scanned(whole, _LINES.split(", "), {"of_supplier": F.col("cents")}, by=("l_suppkey",)).select("l_orderkey", "l_linenumber", "cents", "upto", "of_supplier")


@query("SELECT l_extendedprice AS p95 FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem) WHERE r = floor(CAST(0.95 AS DOUBLE) * (n - 1)) + 1", with_prelude=False)
def line_item_p95(spark, sf_dir):
    found = ordered.nth_value(read(spark, sf_dir, "lineitem"), "l_extendedprice", lambda n: F.floor(F.lit(0.95) * (n - 1)))
    return found.select(F.col("l_extendedprice").alias("p95"))


_MONTHS = "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER)"


@query(f"SELECT t, l_extendedprice AS p95, below FROM (SELECT {_MONTHS} AS t, l_extendedprice, row_number() OVER (PARTITION BY {_MONTHS} ORDER BY l_extendedprice) AS r, rank() OVER (PARTITION BY {_MONTHS} ORDER BY l_extendedprice) - 1 AS below, count(*) OVER (PARTITION BY {_MONTHS}) AS n FROM lineitem) WHERE r = floor(CAST(0.95 AS DOUBLE) * (n - 1)) + 1", with_prelude=False)
def line_item_p95_by_month(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int").alias("t"), "l_extendedprice")
    found = ordered.nth_value(rows, "l_extendedprice", lambda n: F.floor(F.lit(0.95) * (n - 1)), ("t",))
    return found.select("t", F.col("l_extendedprice").alias("p95"), "below")


@query(f"SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_partkey, l_orderkey, l_linenumber, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE r <= n // 10", with_prelude=False)
def first_tenth_of_supplier(spark, sf_dir):
    """The tenth of each supplier's line items of the least quantity; quantities tie a great deal."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    rows = rows.join(rows.groupBy("l_suppkey").agg(F.floor(F.count(F.lit(1)) / 10).alias("n")), "l_suppkey")
    found = ordered.first_rows(rows, F.col("n"), ["l_quantity", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"], ("l_suppkey",))
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query(
    """, c AS (SELECT event_id, min(cost) OVER w AS low, max(cost) OVER w AS high, avg(cost) OVER w AS mu, stddev_pop(cost) OVER w AS sd FROM (SELECT events.event_id, ts, value AS cost FROM events) WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT event_id, round(low, 6) AS low, round(greatest(low, mu - sd), 6) AS open, round(least(high, mu + sd), 6) AS close, round(high, 6) AS high FROM c"""
)
def event_candles(spark, sf_dir):
    """Candles of the last 24 events at every event."""
    found = ordered.sliding(read(spark, sf_dir, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "value", 24)
    return found.select("event_id", "low", F.greatest(F.col("low"), F.col("mean") - F.col("sd")).alias("open"), F.least(F.col("high"), F.col("mean") + F.col("sd")).alias("close"), "high")


# ---- draws


@query(f"SELECT CAST(floor({u('event_id', '0')} * 8) AS BIGINT) AS a, CAST(floor({u('event_id', '1')} * 8) AS BIGINT) AS b, count(*) AS n FROM ev GROUP BY 1, 2")
def joint_draws(spark, sf_dir):
    """How often two draws of an event fall into each two of eight cells."""
    cell = lambda n: F.floor(uniform(F.col("event_id"), F.lit(n)) * 8)
    return events(spark, sf_dir).groupBy(cell(0).alias("a"), cell(1).alias("b")).agg(F.count(F.lit(1)).alias("n"))


_ALIAS = """WITH w AS (SELECT c_custkey AS k, CAST(greatest(0, floor(c_acctbal)) AS BIGINT) AS w FROM customer), t AS (SELECT count(*) AS n, CAST(sum(w) AS BIGINT) AS s FROM w),
c AS (SELECT k, w, n, s, w * n - s AS gap, row_number() OVER (ORDER BY k) - 1 AS slot, CAST(sum(greatest(0, s - w * n)) OVER (ORDER BY k) AS BIGINT) AS d, CAST(sum(greatest(0, w * n - s)) OVER (ORDER BY k) AS BIGINT) AS e FROM w, t),
h AS (SELECT *, lead(k) OVER (ORDER BY k) AS next FROM c WHERE gap >= 0), l AS (SELECT *, d + gap AS start FROM c WHERE gap < 0),
a1 AS (SELECT l.slot, l.k, l.w * l.n AS keep, arg_min(h.k, {'e': h.e, 'k': h.k}) AS alias, l.n, l.s FROM l LEFT JOIN h ON h.e > l.start GROUP BY ALL),
a2 AS (SELECT h.slot, h.k, h.s + h.e - CASE WHEN h.e = 0 THEN 0 ELSE coalesce(min(l.d), h.e) END AS keep, coalesce(h.next, h.k) AS alias, h.n, h.s FROM h LEFT JOIN l ON l.d >= h.e GROUP BY h.slot, h.k, h.s, h.e, h.next, h.n),
tab AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2)"""


def _customers(spark, sf_dir):
    items = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.floor("c_acctbal").alias("weight"))
    return alias.alias_table(items)


@query(_ALIAS + " SELECT slot, k, CAST(keep AS BIGINT) AS keep, alias FROM tab", with_prelude=False)
def customer_alias(spark, sf_dir):
    """The alias table of all customers by balance."""
    return _customers(spark, sf_dir).select("slot", "k", "keep", "alias")


@query(_ALIAS + f", o AS (SELECT o_orderkey, CAST(floor({u('o_orderkey', '1')} * n) AS BIGINT) AS slot, {u('o_orderkey', '2')} AS v FROM orders, t) SELECT o_orderkey, CASE WHEN floor(v * s) < keep THEN k ELSE alias END AS k FROM o JOIN tab USING (slot)", with_prelude=False)
def customer_draws(spark, sf_dir):
    """A customer for every order, drawn by balance."""
    draws = read(spark, sf_dir, "orders").select("o_orderkey")
    return alias.alias_draw(draws, _customers(spark, sf_dir), uniform(F.col("o_orderkey"), F.lit(1)), uniform(F.col("o_orderkey"), F.lit(2)))


# ---- layouts over time: one for each month with orders, every fifth of which is taken back at the month's 15th day

_DAY = "CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"
_LOG = f"""WITH m AS (SELECT DISTINCT CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS BIGINT) AS version, CAST(date_diff('day', DATE '1990-01-01', CAST(date_trunc('month', o_orderdate) AS DATE)) AS BIGINT) AS since FROM orders),
log AS (SELECT since, version FROM m UNION ALL SELECT since + 14, NULL FROM m WHERE version % 5 = 3),
dep AS (SELECT *, sum(CASE WHEN version IS NULL THEN -1 ELSE 1 END) OVER (ORDER BY since) AS depth FROM log),
std AS (SELECT since, last_value(version IGNORE NULLS) OVER (PARTITION BY depth ORDER BY since) AS version FROM dep),
val AS (SELECT since, version, lead(since) OVER (ORDER BY since) AS until FROM std)"""
_VERSIONS = _LOG + """, cuts AS (SELECT version, n_nationkey, CAST(n_nationkey * (3 + version % 4) AS BIGINT) AS lo FROM m, nation),
sl AS (SELECT version, n_nationkey + 1 AS slice_id, lo, coalesce(lead(lo) OVER (PARTITION BY version ORDER BY lo), 1000000000000) AS hi, CAST((n_nationkey * 7 + version) % 8 AS INTEGER) AS server FROM cuts WHERE n_nationkey > 0 OR version % 4 > 0)"""


def _log(spark, sf_dir):
    dates = read(spark, sf_dir, "orders").select("o_orderdate")
    month = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).cast("long").alias("version")
    months = dates.select(month, _day(F.date_trunc("month", "o_orderdate")).alias("since")).distinct()
    return months, months.select("since", "version").unionByName(months.where("version % 5 = 3").select((F.col("since") + 14).alias("since"), F.lit(None).cast("long").alias("version")))


def _day(date):
    return F.date_diff(date.cast("date"), F.lit("1990-01-01").cast("date")).cast("long")


@query(_LOG + " SELECT since, version, until FROM val", with_prelude=False)
def layout_validity(spark, sf_dir):
    """When which layout holds, with changes that are taken back."""
    return versions.validity(_log(spark, sf_dir)[1])


@query(
    _VERSIONS
    + f""", o AS (SELECT {_DAY} AS day, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders), w AS (SELECT o.*, version FROM o ASOF LEFT JOIN val ON o.day >= val.since)
    SELECT version, server, slice_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM w LEFT JOIN sl USING (version) WHERE (o_custkey >= lo AND o_custkey < hi) GROUP BY version, server, slice_id
    UNION ALL SELECT version, NULL, NULL, count(*), CAST(sum(cents) AS BIGINT) FROM w WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.version = w.version AND o_custkey >= lo AND o_custkey < hi) GROUP BY version""",
    with_prelude=False,
)
def orders_by_layout(spark, sf_dir):
    """Orders routed by the layout of their day; customers that no slice holds come without a server."""
    months, log = _log(spark, sf_dir)
    lo = (F.col("n_nationkey") * (3 + F.col("version") % 4)).cast("long")
    cuts = months.select("version").join(F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey")), F.lit(True))  # nations are few in any scale
    cuts = cuts.select("version", "n_nationkey", lo.alias("lo")).where("n_nationkey > 0 OR version % 4 > 0")
    slices = layout.open_ended(cuts, 10**12).select("version", (F.col("n_nationkey") + 1).alias("slice_id"), "lo", "hi", F.lit(1.0).alias("size"), ((F.col("n_nationkey") * 7 + F.col("version")) % 8).cast("int").alias("server"))
    orders = read(spark, sf_dir, "orders").select(_day(F.col("o_orderdate")).alias("day"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    found = versions.routed(orders, log, slices, "day", "o_custkey", "cents")
    return found.groupBy("version", "server", "slice_id").agg(F.sum("n").alias("n"), F.sum("work").cast("long").alias("cents"))
