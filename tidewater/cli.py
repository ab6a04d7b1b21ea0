"""Whole runs from the command line: `python -m tidewater.cli --steps 200 --out-csv series`.

Options are the fields of simulate.Config under the names that users of the domain know, and where the run's files go.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import simulate
from .sources import report, trace

#: Option, field of Config, type, default of a full-size run (fixed values).
OPTIONS = (
    ("seed", "seed", int, 7),
    ("policy", "policy", str, "greedy"),
    ("steps", "steps", int, 2000),
    ("rebalance-every", "every", int, 50),
    ("n-servers", "n_servers", int, 100),
    ("n-keys", "n_keys", int, 100),
    ("nprobe", "nprobe", int, 20),
    ("initial-slices", "cuts", int, 0),
    ("cluster-shards-min", "shards_min", int, 2),
    ("cluster-shards-max", "shards_max", int, 5),
    ("n-hot", "n_hot", int, 2),
    ("hot-mass", "hot_mass", float, 0.8),
    ("hot-skew", "hot_skew", float, 1.2),
    ("burst-mean", "burst_mean", int, 200),
    ("burst-std", "burst_std", int, 50),
    ("burst-min", "burst_min", int, 20),
    ("burst-max", "burst_max", int, 800),
    ("alt-burst-prob", "alt_probability", float, 0.0),
    ("alt-n-hot", "alt_n_hot", int, None),
    ("alt-hot-mass", "alt_hot_mass", float, None),
    ("dist-switch-prob", "switch_probability", float, 0.05),
    ("dist-start-mode", "start_mode", str, "zipf"),
    ("zipf-s", "zipf_s", float, 1.2),
    ("server-capacity", "capacity", float, 1e9),
    ("churn-budget", "churn_budget", float, 5000.0),
    ("migration-K", "max_moves", int, 50),
    ("solver-gap", "gap", float, 0.01),
    ("burn-in", "burn_in", int, 200),
    ("fanout-var-window", "window", int, 200),
    ("trace-state-every", "state_every", int, 1),
    ("requests-per-server", "requests_per_server", int, 10_000),
    ("requests-mean", "requests_mean", int, 0),
    ("requests-std", "requests_std", int, None),
    ("requests-min", "requests_min", int, None),
    ("requests-max", "requests_max", int, None),
    ("fanout-request-samples", "fanout_samples", int, 128),
    ("growth-popular-fraction", "growth_fraction", float, 0.02),
    ("growth-popular-k", "growth_k", int, 0),
    ("growth-frac", "growth_frac", float, 0.05),
    ("growth-add", "growth_add", float, 0.0),
    ("growth-new-shards-max", "growth_parts", int, 3),
)
#: Options that are on or off (`--no-...`), their fields and defaults.
SWITCHES = (
    ("reset-history-on-rebalance", "reset_history", True),
    ("allow-repeat", "allow_repeat", True),
    ("lock-payload-per-step", "lock_payload", True),
    ("split-hot-slices", "split_hot", True),
    ("aggregate-requests", "aggregate", True),
    ("growth-on-rebalance", "growth", True),
    ("include-state-in-csv", "state_in_rows", False),
)
#: Other names of an option.
ALSO = {"solver-gap": ("gurobi-mip-gap",), "growth-popular-fraction": ("growth-cold-fraction",), "growth-popular-k": ("growth-cold-k",)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidewater", description="A run of a sharded, bursty search workload.")
    for option, field, kind, default in OPTIONS:
        choices = {"policy": ("greedy", "ilp"), "start_mode": ("zipf", "uniform")}.get(field)
        out.add_argument(f"--{option}", *[f"--{x}" for x in ALSO.get(option, ())], dest=field, type=kind, default=default, choices=choices)
    for option, field, default in SWITCHES:
        out.add_argument(f"--{option}", dest=field, action=argparse.BooleanOptionalAction, default=default)
    out.add_argument("--solver-time-limit", "--gurobi-time-limit", dest="time_limit", type=float, default=10.0, help="accepted; the assignment ends by itself")
    out.add_argument("--print-current-tick", action="store_true", help="say which part of the run is being worked out")
    out.add_argument("--tick-print-every", type=int, default=1, help="accepted; a run is a few plans, not a loop over ticks")
    out.add_argument("--out-csv", default="timeseries", help="folder of the series as CSV; empty for none")
    out.add_argument("--trace-jsonl", default="", help="folder of the trace as JSON lines; empty for none")
    out.add_argument("--narrative", default="", help="folder of a report of each tick; empty for none")
    return out


def config(argv: Sequence[str] | None = None) -> tuple[simulate.Config, argparse.Namespace]:
    given = parser().parse_args(argv)
    fields = [field for _, field, *_ in OPTIONS] + [field for _, field, _ in SWITCHES]
    return simulate.Config(**{f: getattr(given, f) for f in fields}), given


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs, writes the files, prints and returns the summary."""
    c, given = config(argv)
    spark = spark or SparkSession.builder.appName("tidewater").getOrCreate()
    say = (lambda text: print(f"[run] {text}", flush=True)) if given.print_current_tick else None
    found = simulate.whole_run(spark, c, progress=say)
    servers = list(range(c.n_servers))
    if given.out_csv:
        trace.write_series(found.series, given.out_csv, servers)
    if given.trace_jsonl:
        trace.write_trace(simulate.trace_of(found), given.trace_jsonl)
    if given.narrative:
        told = found.series.select(*[x for x in trace.BASE if x in found.series.columns])
        report.write_report(report.report([report.measured(told)]), given.narrative)
    summary = simulate.summary(found.series).first().asDict()
    print(json.dumps({"steps": c.steps, "policy": c.policy, **summary}))
    return summary


if __name__ == "__main__":
    main()
