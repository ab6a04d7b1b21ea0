"""Files of runs, whole runs and streams."""

import json
import time

from pyspark.sql import functions as F

from tidewater.plans import simulate
from tidewater.sources import report, runs, trace
from tidewater.streaming import ticks


def test_series_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.5, "a,\"b\""), (1, 0.25, None)], "t int, latency double, hot_set string").withColumn("work_s0", F.lit(3.0))
    trace.write_series(df, str(tmp_path / "s"), [0])
    back = trace.read_series(spark, str(tmp_path / "s"), [*trace.BASE, *trace.server_columns([0])])
    assert [(r["t"], r["latency"], r["hot_set"], r["work_s0"], r["fanout"]) for r in back.orderBy("t").collect()] == [(1, 0.25, None, 3.0, None), (2, 1.5, 'a,"b"', 3.0, None)]


def test_trace_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.75)], "t int, latency double")
    steps = df.select("t", F.lit(1).alias("place"), trace.event("step", "t", "latency").alias("line"))
    state = df.limit(1).select(F.lit(0).alias("t"), F.lit(0).alias("place"), trace.event("state", F.lit("init").alias("reason")).alias("line"))
    trace.write_trace([steps, state], str(tmp_path / "t"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert json.loads(lines[0]) == {"type": "state", "reason": "init"}
    assert [tuple(r) for r in trace.read_trace(spark, str(tmp_path / "t"), "step", "t int, latency double").orderBy("t").collect()] == [(1, 0.5), (2, 0.75)]


def test_long_union(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "b int, a string"), spark.createDataFrame([(2.0,)], "c double")
    trace.write_long([a, b], str(tmp_path / "l"))
    assert trace.union_long([a, b]).columns == ["a", "b", "c"]


def test_run(spark, tmp_path):
    c = simulate.Config(steps=30, every=10, fanout_samples=4)
    found = simulate.whole_run(spark, c)
    series = found.series
    trace.write_trace(simulate.trace_of(found), str(tmp_path / "run"))
    events = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "run")).collect()]
    kinds = [e["type"] for e in events]
    assert kinds[0] == "state" and kinds.count("step") == 30 and kinds.count("rebalance") == 3 and kinds.count("growth") == 3
    rows = {r["t"]: r for r in series.collect()}
    assert sorted(rows) == list(range(1, 31))
    for t, r in rows.items():
        loads = json.loads(r["cluster_loads"])
        assert abs(r["workload"] - 1.35 * sum(loads.values())) < 1e-6 * r["workload"]
        assert r["imbalance"] >= 1 and r["work_units"] == r["n_requests"] * c.nprobe
        assert r["rebalance"] == int(t % 10 == 0)
        if t > 1:
            assert r["imbalance_pre"] == rows[t - 1]["imbalance"]
    assert sum(r["rebalance_slice_moved_count"] for r in rows.values()) > 0
    # states in the trace: a step's is that before the tick's rebalance, and rebalances join up
    state, first = None, events[0]["state"]
    for e in events[1:]:
        if e["type"] == "step":
            own = state or first
            assert [x["slice_id"] for x in e["state"]["slices"]] == [x["slice_id"] for x in own["slices"]]
            assert e["state"]["cluster_to_servers"] == own["cluster_to_servers"] and e["state"]["key_to_slice"] == own["key_to_slice"]
            loads = {str(x["slice_id"]): x["load"] for x in e["state"]["slices"]}
            assert all(abs(loads[i] - v) < 1e-6 * max(1, v) for i, v in e["slice_loads"].items())
            assert sum(e["plan_counts"].values()) == e["work_units"]
        if e["type"] == "rebalance":
            assert e["state_before"]["cluster_to_slices"] == (state or first)["cluster_to_slices"]
            state = e["state_after"]
            assert e["diff"]["slice_moved"] == json.loads(rows[e["t"]]["rebalance_slice_moved"])
            servers = {x["slice_id"]: x["server"] for x in e["state_before"]["slices"]}
            after = {x["slice_id"]: x["server"] for x in state["slices"]}
            assert {m["slice_id"]: (m["from"], m["to"]) for m in e["diff"]["slice_moved"]} == {i: (servers[i], after[i]) for i in servers if i in after and servers[i] != after[i]}
            assert {x["slice_id"] for x in e["diff"]["slice_added"]} == set(after) - set(servers)
            # greedy moves do not raise the imbalance of the loads that they go by
            moves = [a for a in e["actions"] if a["kind"] == "reassign"]
            assert all(m["imbalance_after"] <= m["imbalance_before"] + 1e-9 for m in moves)
    # columns of servers agree with the maps
    for t, r in rows.items():
        for m, name in (("work", "server_work_map"), ("util", "server_util_map"), ("slicecount", "server_slice_counts")):
            cells = json.loads(r[name])
            assert all(abs(r[f"{m}_s{s}"] - cells[str(s)]) < 1e-9 * max(1, cells[str(s)]) for s in range(c.n_servers))
    trace.write_series(series, str(tmp_path / "csv"), list(range(c.n_servers)))
    back = trace.read_series(spark, str(tmp_path / "csv"), [*trace.BASE, *trace.server_columns(list(range(c.n_servers)))])
    again = {r["t"]: r for r in back.collect()}
    assert all(again[t]["work_s3"] == rows[t]["work_s3"] and json.loads(again[t]["rebalance_diff"] or "{}") == json.loads(rows[t]["rebalance_diff"]) for t in rows)
    long = report.measured(series.select(*[x for x in trace.BASE if x in series.columns]))
    texts = {r["t"]: r["text"] for r in report.report([long]).collect()}
    assert f"- n_requests (run) = {rows[10]['n_requests']}\n" in texts[10] and "- rebalance (run) = 1" in texts[10] and "- rebalance (run) = 0" in texts[9]


def test_traces_are_a_data_source(spark, tmp_path):
    lines = [{"type": kind, "t": t, "state": {"slices": [{"slice_id": t}]}, "n": t * 10} for t in range(1, 9) for kind in ("step", "state")]
    texts = [json.dumps(x, separators=(",", ":")) for x in lines] + ["no json", "[1]", '{"t": 3, "type": "step", "n": "late fields"}', "", json.dumps({"type": "begin"})]
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(texts[k::3]))
    (tmp_path / "_SUCCESS").write_text("")
    runs.register(spark)
    everything = spark.read.format("tidewater_trace").load(str(tmp_path))
    assert everything.rdd.getNumPartitions() == 3 and everything.count() == len([x for x in texts if x])
    steps = runs.trace(spark, str(tmp_path), "step", 3, 5)
    rows = steps.select("t", *runs.fields("line", n="int"), F.expr("try_variant_get(try_parse_json(line), '$.state.slices[0].slice_id', 'int')").alias("first")).collect()
    assert sorted(map(tuple, rows), key=repr) == [(3, 30, 3), (3, None, None), (4, 40, 4), (5, 50, 5)]
    assert steps.where("t > 4").union(steps.where("t < 4")).count() == 3
    reader = runs.TraceReader(str(tmp_path), "step", 7)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    assert everything.where("type IS NULL").count() == 2 and everything.where("t IN (1, 8)").count() == 4
    assert spark.read.format("tidewater_trace").load(f"file://{tmp_path}/part-0.txt").count() > 0


def test_single_requests(spark):
    """A plan for each request: fan-out with the primaries, heat within a tick, with and without a payload of its own."""
    base = {"steps": 6, "every": 3, "n_servers": 4, "n_keys": 10, "nprobe": 4, "requests_mean": 12, "requests_std": 2, "burst_mean": 5}
    for more in ({}, {"lock_payload": False}, {"allow_repeat": False}):
        c = simulate.Config(**base, aggregate=False, **more)
        rows = simulate.run(spark, c).collect()
        assert len(rows) == 6 and all(r["work_units"] == r["n_requests"] * 4 and r["fanout_req_samples"] == r["n_requests"] for r in rows)
        assert all(r["latency"] >= r["workload"] - 1e-9 and r["fanout"] >= r["fanout_req_mean"] for r in rows)
    plain = simulate.run(spark, simulate.Config(**base, fanout_samples=0, state_in_rows=True, reset_history=False, policy="ilp", split_hot=False, growth=False)).collect()
    assert all(r["fanout_req_mean"] == r["fanout"] and r["fanout_req_var"] == 0 and r["fanout_req_samples"] == 0 for r in plain)
    assert all(len(json.loads(r["state_key_to_server"])) == 10 for r in plain)
    assert all(r["imbalance"] > 0 for r in plain)


def test_config():
    c = simulate.Config(hot_mass=3.0, alt_probability=-1.0, burst_min=0, start_mode="other", requests_mean=100, requests_max=5)
    assert (c.hot_mass, c.alt_probability, c.burst_min, c.start_mode, c.requests()) == (1.0, 0.0, 1, "zipf", (100, 20, 40, 40))
    assert len(simulate.grid()) == 19 and simulate.grid()["every-10"].every == 10


def test_keys_need_slices():
    c = simulate.Config(n_keys=5)
    whole = simulate.first_layout(c)
    simulate.require_covered(c, whole, 1)
    try:
        simulate.require_covered(c, whole[whole["k"] != 3], 1)
    except KeyError as e:
        assert "3" in str(e)
    else:
        raise AssertionError("a key without a slice went unseen")


def test_run_agrees_with_the_operators(spark):
    """What whole runs work out on the driver is what the operators give on the same layouts."""
    import numpy as np

    from tidewater.operators import diff, layout, routing

    c = simulate.Config(n_keys=12, n_servers=5)
    before = simulate.first_layout(c)
    loads = np.array([float(k % 5) for k in range(12)])
    before = simulate._with_loads(before, loads)
    cut, actions = simulate._split(c, before, [2, 4])
    after = cut.assign(server=[(s + 1) % 5 if i % 4 == 0 else s for i, s in zip(cut["slice_id"], cut["server"])])
    frame = lambda df: spark.createDataFrame([(int(i), int(k), int(k) + 1, float(z), int(v), float(x)) for i, k, z, v, x in zip(*(df[n] for n in ("slice_id", "k", "size", "server", "load")))], "slice_id long, lo int, hi int, size double, server int, load double")
    a, b = frame(before), frame(after)
    work = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(loads)], "t int, k int, cost double")
    got = {r["slice_id"]: r["load"] for r in routing.slice_loads(work, a.drop("load")).collect()}
    assert all(abs(got[i] - x) < 1e-9 for i, x in zip(before["slice_id"], before["load"]))
    hot = spark.createDataFrame([(2,), (4,)], "k int")
    assert sorted(r["slice_id"] for r in layout.hottest_slices(a, hot).collect()) == sorted(x["parent_slice"] for x in actions)
    row, plain = diff.whole(a, b).first(), simulate._changes(before, after)
    assert [r["slice_id"] for r in row["slice_added"]] == [x["slice_id"] for x in plain["slice_added"]]
    assert [r["slice_id"] for r in row["slice_removed"]] == [x["slice_id"] for x in plain["slice_removed"]]
    assert [tuple(r) for r in row["slice_moved"]] == [tuple(x.values()) for x in plain["slice_moved"]]
    assert [tuple(r) for r in row["key_migrations"]] == [tuple(x.values()) for x in plain["key_migrations"]]
    assert [(r["cluster"], list(r["slices_before"]), list(r["servers_after"])) for r in row["cluster_transitions"]] == [(x["cluster"], x["slices_before"], x["servers_after"]) for x in plain["cluster_transitions"]]
    whole, own = layout.state(b).first(), simulate.state(after)
    assert list(whole["key_to_slice"]) == own["key_to_slice"] and [list(x) for x in whole["cluster_to_servers"]] == own["cluster_to_servers"]
    assert [r.asDict() for r in whole["slices"]] == own["slices"]


def test_versions(spark):
    from tidewater.operators import layout

    slices = spark.createDataFrame([(1, 0, 1, 1.0, 0), (2, 1, 2, 1.0, 0)], "slice_id long, lo int, hi int, size double, server int")
    v = layout.Versions(slices)
    v.apply(layout.reassign, spark.createDataFrame([(2, 3)], "slice_id long, to int"))
    assert sorted(r["server"] for r in v.now.collect()) == [0, 3]
    assert v.undo() is slices
    try:
        v.undo()
    except ValueError:
        return
    raise AssertionError("undone more than was done")


def test_sweep(spark):
    got = simulate.sweep(spark, {"a": simulate.Config(steps=5), "bad": simulate.Config(steps=5, policy="none")}, 2).collect()
    assert {(r["name"], r["replicate"], r["error"] is None) for r in got} == {("a", 0, True), ("a", 1, True), ("bad", 0, False), ("bad", 1, False)}


def test_stream_heat_over_batches(spark, tmp_path):
    """Ticks that come in several batches give the series of one."""
    whole = [(t, 0, float(t % 4)) for t in range(1, 21)]
    for n in range(4):
        spark.createDataFrame(whole[5 * n : 5 * n + 5], "t int, server int, work double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("t int, server int, work double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ticks.run_to_end(ticks.heat(source), "heat_batches", "append", str(tmp_path / "state")).orderBy("t").collect()
    heat, seen = 0.0, {r["t"]: r["heat"] for r in got}
    for t, _, w in whole:
        heat = (heat + 0.01 * w) * 0.98
        if t in seen:
            assert abs(seen[t] - heat) < 1e-9
    assert len(seen) == 20


def test_parts_can_be_replaced(spark):
    """A policy that moves nothing, and a cost model without heat."""
    parts = simulate.Parts(reassign=lambda c, layout, popularity: (layout, []), heat=lambda w: w.select("t", "server", "work", F.col("work").alias("latency"), F.lit(0.0).alias("heat")))
    rows = simulate.run(spark, simulate.Config(steps=12, every=4, fanout_samples=2, growth_frac=0.0, split_hot=False), parts).collect()
    assert all(r["rebalance_slice_moved_count"] == 0 and abs(r["latency"] - r["workload"]) < 1e-6 * r["workload"] for r in rows)


def test_late_ticks_wait_and_the_latest_are_told_as_such(spark, tmp_path):
    rows = [[(5, 0, 7.0), (1, 0, 1.0), (2, 1, 3.0)], [(3, 0, 2.0), (5, 0, 1.0), (9, 0, 4.0)], [(2, 0, 5.0), (8, 0, 1.0), (40, 1, 1.0)], [(None, 0, 0.0), (None, 1, 0.0)]]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "t int, server int, work double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files go by their time of change
    source = spark.readStream.schema("t int, server int, work double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ticks.run_to_end(ticks.patient_heat(source, 4), "patient_test", "append", str(tmp_path / "state")).collect()
    told = sorted((r["server"], r["t"], r["work"]) for r in got if not r["late"])
    assert told == [(0, 1, 1.0), (0, 3, 2.0), (0, 5, 8.0), (0, 8, 1.0), (0, 9, 4.0), (1, 2, 3.0), (1, 40, 1.0)]
    assert [(r["server"], r["t"], r["work"]) for r in got if r["late"]] == [(0, 2, 5.0)]
    heat, last = 0.0, 0
    for server, t, work in told:
        if server == 0:
            heat *= 0.98 ** (t - last - 1)
            [r] = [x for x in got if x["server"] == 0 and x["t"] == t and not x["late"]]
            assert abs(r["latency"] - work * (1 + 0.0005 * heat)) < 1e-9
            heat, last = (heat + 0.01 * work) * 0.98, t
            assert abs(r["heat"] - heat) < 1e-9
