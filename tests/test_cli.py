"""Runs from the command line, and progress."""

import json
import time

import pytest

from tidewater import cli
from tidewater.plans import simulate
from tidewater.sources import trace
from tidewater.streaming.progress import Progress


def test_options():
    c, given = cli.config([])
    assert (c.steps, c.n_servers, c.requests(), c.reset_history, c.growth_fraction) == (2000, 100, (1_000_000, 200_000, 400_000, 1_600_000), True, 0.02)
    c, given = cli.config(["--no-allow-repeat", "--growth-cold-k", "4", "--migration-K", "3", "--requests-mean", "50", "--no-growth-on-rebalance", "--alt-n-hot", "5"])
    assert (c.allow_repeat, c.growth_k, c.max_moves, c.requests()[0], c.growth, c.alt_n_hot) == (False, 4, 3, 50, False, 5)
    fields = set(simulate.Config.__dataclass_fields__)
    assert {f for _, f, *_ in cli.OPTIONS} | {f for _, f, _ in cli.SWITCHES} <= fields


def test_main(spark, tmp_path, capsys):
    args = "--steps 8 --rebalance-every 4 --n-servers 3 --n-keys 6 --nprobe 4 --requests-mean 100 --fanout-request-samples 2 --print-current-tick".split()
    found = cli.main([*args, "--out-csv", str(tmp_path / "csv"), "--trace-jsonl", str(tmp_path / "trace"), "--narrative", str(tmp_path / "log")], spark)
    said = capsys.readouterr().out
    assert "[run] layouts of 2 rebalances" in said and json.loads(said.splitlines()[-1])["avg_latency"] == found["avg_latency"]
    rows = trace.read_series(spark, str(tmp_path / "csv"), [*trace.BASE, *trace.server_columns([0, 1, 2])]).collect()
    assert len(rows) == 8 and all(r["work_s2"] is not None for r in rows)
    assert trace.read_trace(spark, str(tmp_path / "trace"), "rebalance", "t int, policy string").count() == 2
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert text.startswith("## tick 1\n") and text.count("## tick ") == 8 and "- imbalance (run) = " in text
    with pytest.raises(SystemExit):
        cli.config(["--chunk-size", "5"])


def test_progress(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    said = []
    listener = Progress(said.append)
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).queryName("five").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if any("ended" in x for x in said):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert said[0] == "[stream] five started" and any("5 rows" in x for x in said)
