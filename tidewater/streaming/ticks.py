"""Tick metrics as Structured Streaming: loads of tumbling windows, heat as keyed state, layouts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.metrics import ALPHA, BETA, DECAY

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def tick_loads(events: DataFrame, n_keys: int, watermark: str | None = None, length: str = "1 hour") -> DataFrame:
    """tick_start, k, load, n over event time. With a watermark, late events beyond it are left out and closed ticks freed."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        events = events.withWatermark("ts", watermark)
    tick = F.window("ts", length)
    out = events.groupBy(tick.alias("w"), (F.col("user_id") % n_keys).cast("int").alias("k")).agg(F.sum("value").alias("load"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("tick_start"), "k", "load", "n")


def _heat(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Ticks of one server in order; what lies between two of them only cools."""
    last, heat = state.get if state.exists else (0, 0.0)
    pdf = pd.concat(list(batches)).groupby("t", as_index=False)["work"].sum().sort_values("t")
    rows = []
    for t, work in zip(pdf["t"], pdf["work"]):
        if t <= last:
            continue  # a tick is told once
        heat *= (1 - DECAY) ** (t - last - 1)
        rows.append((key[0], int(t), float(work), float(work * (1 + ALPHA * heat)), float((heat + BETA * work) * (1 - DECAY))))
        last, heat = int(t), rows[-1][4]
    state.update((last, float(heat)))
    yield pd.DataFrame(rows, columns=["server", "t", "work", "latency", "heat"])


def heat(ticks: DataFrame) -> DataFrame:
    """server, t, work, latency, heat from a stream of whole ticks (t, server, work) that come in order; patient_heat() waits for late ones."""
    return ticks.groupBy("server").applyInPandasWithState(_heat, "server int, t int, work double, latency double, heat double", "last int, heat double", "append", GroupStateTimeout.NoTimeout)


class _Patient(StatefulProcessor):
    """Ticks of one server, told in order when they are `wait` ticks behind the newest one; the others wait as state."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "t bigint, heat double, newest bigint")
        self.waiting = handle.getMapState("waiting", "t bigint", "work double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, heat_, newest = self.told.get() if self.told.exists() else (0, 0.0, 0)
        late, ends = [], False
        for pdf in rows:
            ends |= bool(pdf["t"].isna().any())
            per = pdf.dropna(subset=["t"]).groupby("t")["work"].sum()
            for t, work in zip(per.index.astype(int).tolist(), per.tolist()):
                if t <= last:
                    late.append((key[0], t, float(work), None, None, True))
                    continue
                before = self.waiting.getValue((t,))[0] if self.waiting.containsKey((t,)) else 0.0
                self.waiting.updateValue((t,), (before + float(work),))
                newest = max(newest, t)
        due = sorted((t, work) for (t,), (work,) in self.waiting.iterator() if ends or t <= newest - self.wait)
        out = []
        for t, work in due:
            heat_ *= (1 - DECAY) ** (t - last - 1)
            out.append((key[0], t, work, work * (1 + ALPHA * heat_), (heat_ + BETA * work) * (1 - DECAY), False))
            last, heat_ = t, out[-1][4]
            self.waiting.removeKey((t,))
        self.told.update((last, float(heat_), newest))
        yield pd.DataFrame(out + late, columns=["server", "t", "work", "latency", "heat", "late"]).astype({"latency": float, "heat": float, "late": bool})

    def close(self) -> None:
        pass


def patient_heat(parts: DataFrame, wait: int) -> DataFrame:
    """server, t, work, latency, heat, late from a stream of work (t, server, work) in any order and any number of parts.

    A server's tick is told once the server's newest one is `wait` ticks ahead; until then its parts are summed. What
    comes later still is not lost: it comes out as it is, with late = true and no latency or heat. A row without t tells
    all that waits (the end of a run). The state of a server is its last tick and at most what waits.
    """
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = "server int, t int, work double, latency double, heat double, late boolean"
    return parts.groupBy("server").transformWithStateInPandas(_Patient(wait), out, "Append", "None")


def run_to_end(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, as a table in memory: for tests and small results."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def each_batch(df: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """act(batch, id) for each micro-batch: where a rebalancer reads its loads and writes a new layout."""
    return df.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path)
