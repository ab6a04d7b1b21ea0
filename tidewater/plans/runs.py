"""Queries on streams. Whole runs make their own workload and read no table: they are called from the command line, not registered."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import shared
from ..streaming import ticks as stream
from .bind import bound, query, read


def _events(spark, sf_dir):
    """The events as a stream: a folder of files of the table."""
    folder = f"{shared.folder(spark)}/events"
    read(spark, sf_dir, "events").repartition(3, "event_id").write.parquet(folder)
    return stream.read_events(spark, folder, 1), folder


@query("SELECT t, k, round(sum(cost), 6) AS load, count(*) AS n FROM ev GROUP BY t, k")
def stream_tick_load(spark, sf_dir):
    source, folder = _events(spark, sf_dir)
    out = stream.run_to_end(stream.tick_loads(source, 20, "1 hour"), f"tick_load_{uuid.uuid4().hex[:8]}", "complete", folder + "-state")
    t = F.floor((F.unix_timestamp("tick_start") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600) + 1
    return out.select(t.cast("int").alias("t"), "k", "load", "n")


@query(", w AS (SELECT t, server, CAST(sum(coalesce(cost, 0)) AS DOUBLE) AS work FROM ticks CROSS JOIN servers LEFT JOIN (SELECT t, k % 8 AS server, cost FROM ev) USING (t, server) GROUP BY t, server), h AS (SELECT t, server, work, power(CAST(0.98 AS DOUBLE), t + 1) * sum(CAST(0.01 AS DOUBLE) * work * power(CAST(0.98 AS DOUBLE), -t)) OVER (PARTITION BY server ORDER BY t) AS heat FROM w) SELECT server, t, round(work, 6) AS work, round(work * (1 + CAST(0.0005 AS DOUBLE) * coalesce(lag(heat) OVER (PARTITION BY server ORDER BY t) * power(CAST(0.98 AS DOUBLE), t - 1 - lag(t) OVER (PARTITION BY server ORDER BY t)), 0)), 6) AS latency, round(heat, 6) AS heat FROM h")
def stream_heat(spark, sf_dir):
    b = bound(spark, sf_dir)
    from ..operators.routing import filled

    work = b.work.groupBy("t", (F.col("k") % 8).alias("server")).agg(F.sum("cost").alias("work"))
    totals = filled(b.work.select("t").distinct(), b.servers.select("server"), work, "server", "work").select("t", "server", "work")
    folder = f"{shared.folder(spark)}/ticks"
    totals.coalesce(1).write.parquet(folder)
    source = spark.readStream.schema("t int, server int, work double").parquet(folder)
    return stream.run_to_end(stream.heat(source), f"heat_{uuid.uuid4().hex[:8]}", "append", folder + "-state")


_PARTS = ", p AS (SELECT t, CAST(k % 8 AS INTEGER) AS server, CAST(round(sum(cost) * 100) AS BIGINT) / 100 AS work FROM ev GROUP BY 1, 2)"


@query(
    _PARTS
    + """, h AS (SELECT server, t, work, power(CAST(0.98 AS DOUBLE), t + 1) * sum(CAST(0.01 AS DOUBLE) * work * power(CAST(0.98 AS DOUBLE), -t)) OVER (PARTITION BY server ORDER BY t) AS heat FROM p)
    SELECT server, t, round(work, 6) AS work, round(work * (1 + CAST(0.0005 AS DOUBLE) * coalesce(lag(heat) OVER (PARTITION BY server ORDER BY t) * power(CAST(0.98 AS DOUBLE), t - 1 - lag(t) OVER (PARTITION BY server ORDER BY t)), 0)), 6) AS latency, round(heat, 6) AS heat, false AS late FROM h"""
)
def stream_heat_shuffled(spark, sf_dir):
    """Events as files in no order of time: heat is that of the batch, as no tick is told before the run's end."""
    folder = f"{shared.folder(spark)}/parts"
    parts = bound(spark, sf_dir).work.select("t", (F.col("k") % 8).cast("int").alias("server"), F.col("cost").alias("work"))
    parts.repartition(4, F.col("t") % 13).write.parquet(folder)
    parts.select("server").distinct().select(F.lit(None).cast("int").alias("t"), "server", F.lit(0.0).alias("work")).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema("t int, server int, work double").option("maxFilesPerTrigger", 2).option("latestFirst", False).parquet(folder)
    return stream.run_to_end(stream.patient_heat(source, 10**6), f"patient_{uuid.uuid4().hex[:8]}", "append", folder + "-state")
