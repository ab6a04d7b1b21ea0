"""Files of a run: time series as CSV, trace events as JSON lines, summaries as JSON; reports are in report.py.

All of them are written by executors, a file per task. One file per run is a matter of the number of partitions, which
the caller sets; series of ticks are small enough for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a time series, in the order of the file; columns of servers follow them.
BASE = (
    "t latency fanout fanout_req_mean fanout_req_var fanout_req_min fanout_req_max fanout_req_samples fanout_var imbalance imbalance_pre "
    "hottest_server coldest_server hottest_work_server coldest_work_server hottest_work coldest_work mean_work rebalance growth_event "
    "growth_added_total growth_slices growth_servers growth_clusters growth_actions burn_in n_requests work_units workload dist_mode dist_switch dist_id "
    "burst_id burst_start burst_mode burst_len burst_remaining hot_mass hot_probe_ratio hot_set hot_weights cluster_loads hottest_slice coldest_slice "
    "hottest_slice_load coldest_slice_load slice_loads n_slices_total n_clusters_total server_work_map server_heat_map server_util_map "
    "server_keyspace_map server_slice_counts rebalance_actions rebalance_diff rebalance_key_migrations rebalance_cluster_transitions rebalance_slice_added "
    "rebalance_slice_removed rebalance_slice_moved rebalance_key_migration_count rebalance_cluster_transition_count rebalance_slice_added_count "
    "rebalance_slice_removed_count rebalance_slice_moved_count"
).split()
_INTS = set("t fanout_req_samples hottest_server coldest_server hottest_work_server coldest_work_server rebalance growth_event growth_slices burn_in dist_switch dist_id burst_id burst_start burst_len burst_remaining n_slices_total n_clusters_total".split())
_LONGS = {"n_requests", "work_units", "hottest_slice", "coldest_slice"} | {c for c in BASE if c.endswith("_count")}
_TEXTS = {"dist_mode", "burst_mode", "hot_set", "hot_weights", "cluster_loads", "slice_loads", *(c for c in BASE if c.endswith("_map") or c == "server_slice_counts"), *(c for c in BASE if c.startswith("rebalance_") and not c.endswith("_count")), "growth_servers", "growth_clusters", "growth_actions"}


def kind(column: str) -> str:
    if column in _INTS or column.startswith("slicecount_s"):
        return "int"
    return "bigint" if column in _LONGS else "string" if column in _TEXTS else "double"


def schema(columns: list[str]) -> str:
    return ", ".join(f"`{c}` {kind(c)}" for c in columns)


def server_columns(ids: list[int]) -> list[str]:
    return [f"{m}_s{s}" for s in ids for m in ("work", "keyspace", "heat", "util", "slicecount")]


def read_series(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A time series without inference: known columns have their types; empty cells are null."""
    columns = columns or BASE
    return spark.read.schema(schema(columns)).option("header", True).option("escape", '"').csv(path)


def write_series(series: DataFrame, path: str, servers: list[int]) -> None:
    """Wide CSV in the fixed order; missing columns and nulls are empty cells."""
    order = [*BASE, *server_columns(servers)]
    have = set(series.columns)
    cells = [F.col(c) if c in have else F.lit(None).cast(kind(c)).alias(c) for c in order]
    series.select(*cells).coalesce(1).sortWithinPartitions("t").write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def union_long(parts: list[DataFrame]) -> DataFrame:
    """All rows under the sorted union of all columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_long(parts: list[DataFrame], path: str) -> None:
    union_long(parts).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def event(kind_: str, *fields: str | Column) -> Column:
    """One JSON line of a trace."""
    return F.to_json(F.struct(F.lit(kind_).alias("type"), *fields))


def raw(line: Column, nested: list[str]) -> Column:
    """The line with further fields whose columns are JSON already."""
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f',"{c}":'), F.col(c))).otherwise("") for c in nested]
    return F.concat(F.substring(line, F.lit(1), F.length(line) - 1), *fields, F.lit("}"))


def write_trace(events: list[DataFrame], path: str) -> None:
    """events: each with t, place (order within the tick) and line."""
    out = events[0].select("t", "place", "line")
    for e in events[1:]:
        out = out.unionByName(e.select("t", "place", "line"))
    out.coalesce(1).sortWithinPartitions("t", "place").select("line").write.mode("overwrite").text(path)


def read_trace(spark: SparkSession, path: str, kind_: str, fields: str) -> DataFrame:
    """Typed events of one kind: state, step, growth or rebalance. fields: a schema; without one see runs.TraceSource."""
    lines = spark.read.text(path).select(F.from_json("value", f"type string, {fields}").alias("e"))
    return lines.where(F.col("e.type") == kind_).select("e.*").drop("type")


def run_summary(series: DataFrame, config: dict[str, str]) -> DataFrame:
    """One row: the configuration and the metrics of the last tick."""
    metrics = [c for c, k in series.dtypes if k in ("double", "int", "bigint") and c != "t"]
    last = series.agg(F.count(F.lit(1)).alias("rows"), *[F.max_by(c, "t").alias(c) for c in metrics])
    given = F.create_map(*[F.lit(x) for pair in sorted(config.items()) for x in pair]) if config else F.create_map().cast("map<string,string>")
    return last.select(given.alias("config"), F.struct(*last.columns).alias("final"))
