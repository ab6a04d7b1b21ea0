"""The test tables in the roles of the domain: ticks, keys, work, slices and servers, in Spark and in SQL.

events: a tick is an hour from 1, a key user_id % 20, the cost `value`; 8 servers.
lineitem: a tick is a ship month from 1, a key l_partkey % 100, the cost l_quantity; 16 servers.
Keys, their sizes and the servers come from customer, so layouts do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass(frozen=True)
class Bound:
    """One binding's tables."""

    work: DataFrame
    keys: DataFrame
    slices: DataFrame
    home: DataFrame
    servers: DataFrame


SIZES = {"events": (20, 8), "lineitem": (100, 16)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keys(customers: DataFrame, n: int) -> DataFrame:
    """k, size: customers by their number, and a size from 1 to 5 from their nations."""
    k = (F.col("c_custkey") % n).cast("int").alias("k")
    return customers.groupBy(k).agg((1 + F.sum("c_nationkey") % 5).cast("double").alias("size"))


def servers(customers: DataFrame, n: int) -> DataFrame:
    server = (F.col("c_custkey") % n).cast("int").alias("server")
    return customers.select(server).distinct().select("server", (40 + F.col("server") % 3 * 5).cast("double").alias("capacity"))


def home_layout(keys_: DataFrame, n_servers: int) -> DataFrame:
    weight = lambda k, p: F.lit(0.2) + (k * 31 + p * 17) % 100 / F.lit(100.0)
    return layout.multi_shard(keys_, 2 + F.col("k") % 4, weight, n_servers)


def spread(home: DataFrame, n_servers: int) -> DataFrame:
    return layout.reassign(home, home.select("slice_id", ((F.col("lo") * 3 + F.col("slice_id")) % n_servers).cast("int").alias("to")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return read(spark, sf_dir, "events").select((hour + 1).cast("int").alias("t"), (F.col("user_id") % 20).cast("int").alias("k"), F.col("value").alias("cost"), "event_id", "event_type", "user_id", "props")


def bound(spark: SparkSession, sf_dir: str, data: str = "events") -> Bound:
    n_keys, n_servers = SIZES[data]
    if data == "events":
        work = events(spark, sf_dir).select("t", "k", "cost")
    else:
        month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
        work = read(spark, sf_dir, "lineitem").select(month.cast("int").alias("t"), (F.col("l_partkey") % 100).cast("int").alias("k"), F.col("l_quantity").alias("cost"))
    customers = read(spark, sf_dir, "customer")
    own = keys(customers, n_keys)
    home = home_layout(own, n_servers)
    return Bound(work, own, spread(home, n_servers), home, servers(customers, n_servers))


def prelude(data: str) -> str:
    n_keys, n_servers = SIZES[data]
    rows = {
        "events": "SELECT CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) + 1 AS t, CAST(user_id % 20 AS INTEGER) AS k, value AS cost, event_id, event_type, user_id, props FROM events",
        "lineitem": "SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS t, CAST(l_partkey % 100 AS INTEGER) AS k, l_quantity AS cost FROM lineitem",
    }[data]
    return f"""
WITH ev AS ({rows}),
keys AS (SELECT CAST(c_custkey % {n_keys} AS INTEGER) AS k, CAST(1 + sum(c_nationkey) % 5 AS DOUBLE) AS size FROM customer GROUP BY 1),
servers AS (SELECT server, CAST(40 + server % 3 * 5 AS DOUBLE) AS capacity FROM (SELECT DISTINCT CAST(c_custkey % {n_servers} AS INTEGER) AS server FROM customer)),
part AS (SELECT k, size, CAST(unnest(range(2 + k % 4)) AS INTEGER) AS p FROM keys),
weighted AS (SELECT *, CAST(0.2 AS DOUBLE) + CAST((k * 31 + p * 17) % 100 AS DOUBLE) / 100 AS w FROM part),
home AS (SELECT row_number() OVER (ORDER BY k, p) AS slice_id, k AS lo, k + 1 AS hi, size * w / sum(w) OVER (PARTITION BY k) AS size, k % {n_servers} AS server FROM weighted),
slices AS (SELECT slice_id, lo, hi, size, CAST((lo * 3 + slice_id) % {n_servers} AS INTEGER) AS server FROM home),
keymap AS (SELECT lo AS k, slice_id, server, size, row_number() OVER (PARTITION BY lo ORDER BY size DESC, slice_id) AS nth FROM slices),
prim AS (SELECT k, server FROM keymap WHERE nth = 1),
loads AS (SELECT t, k, sum(cost) AS load FROM ev GROUP BY t, k),
shares AS (SELECT k, slice_id, server, size / sum(size) OVER (PARTITION BY k) AS share FROM keymap),
alloc AS (SELECT t, k, slice_id, server, load * share AS load FROM loads JOIN shares USING (k)),
ticks AS (SELECT DISTINCT t FROM ev),
sload AS (SELECT t, server, capacity, coalesce(sum(load), 0) AS load FROM ticks CROSS JOIN servers LEFT JOIN alloc USING (t, server) GROUP BY t, server, capacity),
util AS (SELECT t, server, CASE WHEN capacity > 1e-12 THEN load / capacity ELSE 0 END AS util FROM sload),
routed AS (SELECT t, server, load AS work FROM alloc UNION ALL SELECT t, server, load * CAST(0.35 AS DOUBLE) FROM loads JOIN prim USING (k)),
work AS (SELECT t, server, coalesce(sum(work), 0) AS work FROM ticks CROSS JOIN servers LEFT JOIN routed USING (t, server) GROUP BY t, server)"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that the order of a sum does not show; moved off ties, which costs in cents make."""
    return df.select(*[F.round(F.col(f"`{c}`") + OFF_TIES, 6).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


OFF_TIES = 3e-9


def query(sql: str | None = None, data: str = "events", with_prelude: bool = True, recursive: bool = False):
    """Registers a query under its function's name. sql: what follows the prelude (further CTEs begin with a comma); its roundings to 6 decimals are moved off ties likewise."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            before = prelude(data) + "\n" if with_prelude else ""
            before = before.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else before
            SQL[f.__name__] = before + sql.replace(", 6)", f" + {OFF_TIES}, 6)")
        return f

    return register
