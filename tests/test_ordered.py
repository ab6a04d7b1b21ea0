import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewater.operators import intervals, ordered


def spread(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.fixture(params=[1, 5])
def parts(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def shuffled(spark, rows, schema):
    rows = list(rows)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_numbers_follow_the_order(spark, parts):
    df = shuffled(spark, [(i * 3 % 1009, i % 7) for i in range(1009)], "a int, b int")
    got = {r["a"]: r["row"] for r in ordered.numbered(df, ["a"]).collect()}
    assert got == {a: n + 1 for n, a in enumerate(sorted(got))} and len(got) == 1009
    plan = ordered.numbered(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_sums_and_last_values_by_group(spark, parts):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(-5, 9) if i % 4 else None, f"v{i}" if i % 5 == (g or 0) % 5 else None) for g, n in ((None, 40), (1, 3), (2, 400), (3, 1), (4, 60)) for i in range(n)]
    df = shuffled(spark, rows, "g int, i int, x long, v string")
    got = ordered.scanned(df, ["i"], {"s": F.col("x"), "n": F.lit(1).cast("long")}, {"known": F.col("v")}, by=("g",)).collect()
    want, state = {}, {}
    for g, i, x, v in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        s, n, known = state.get(g, (0, 0, None))
        state[g] = want[g, i] = (s + (x or 0), n + 1, v or known)
    assert {(r["g"], r["i"]): (r["s"], r["n"], r["known"]) for r in got} == want
    whole = ordered.scanned(df.where("g = 2"), ["i"], {"s": F.col("x") * 0.5})
    assert sum(r["s"] for r in whole.where("i = 399").collect()) == sum(r[2] or 0 for r in rows if r[0] == 2) / 2


@pytest.mark.parametrize("following, strict", [(False, False), (False, True), (True, False), (True, True)])
def test_asof(spark, parts, following, strict):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(100)) for i in range(200)]
    right = [(rng.choice("ab"), rng.randrange(100), i) for i in range(60)]
    got = ordered.asof(shuffled(spark, left, "id int, g string, t int"), shuffled(spark, right, "g string, s int, version int"), "t", "s", ["version"], by=("g",), following=following, strict=strict, ties=["version"])
    for r in got.collect():
        near = [(s, v) for g, s, v in right if g == r["g"] and ((s > r["t"] or s == r["t"] and not strict) if following else (s < r["t"] or s == r["t"] and not strict))]
        best = (min(near) if following else max(near))[1] if near else None
        assert r["version"] == best, r
    assert got.count() == 200


@pytest.mark.parametrize("window, chunk", [(1, 10), (7, 10), (24, 1000), (50, 5)])
def test_sliding_frames(spark, parts, window, chunk):
    rng = random.Random(4)
    values = [round(rng.uniform(-50, 1000), 2) for _ in range(300)]
    df = shuffled(spark, [(i, v) for i, v in enumerate(values)] + [(900, None)], "i int, v double")
    got = {r["i"]: r for r in ordered.sliding(df, ["i"], "v", window, chunk).collect()}
    assert len(got) == 300
    for i in range(300):
        own = values[max(0, i - window + 1) : i + 1]
        r = got[i]
        assert (r["low"], r["high"], r["v"]) == (min(own), max(own), values[i])
        assert abs(r["mean"] - statistics.fmean(own)) < 1e-9 and abs(r["sd"] - statistics.pstdev(own)) < 1e-6


def test_ranks(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([1.5, 2.5, rng.uniform(-1e6, 1e6), 1e9]) if g else 7.0) for g in (0, 1, 2) for _ in range(700)] + [(3, None), (4, -1.0)]
    df = shuffled(spark, rows, "g int, v double")
    for rank, pick in ((lambda n: F.floor(F.lit(0.95) * (n - 1)), lambda n: int(0.95 * (n - 1))), (lambda n: F.lit(0), lambda n: 0), (lambda n: n - 1, lambda n: n - 1)):
        want = {}
        for g in (0, 1, 2, 4):
            own = sorted(v for h, v in rows if h == g)
            v = own[pick(len(own))]
            want[g] = (v, own.index(v), own.count(v))
        assert {r["g"]: (r["v"], r["below"], r["at"]) for r in ordered.nth_value(df, "v", rank, ("g",)).collect()} == want
    own = sorted(v for _, v in rows if v is not None)
    [r] = ordered.nth_value(df, "v", lambda n: F.floor(n / 2)).collect()
    assert r["v"] == own[len(own) // 2]


def test_first_rows(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.randrange(4)), rng.randrange(3), i) for g in (0, 1, 2) for i in range(120)]
    df = shuffled(spark, rows, "g int, a double, b int, i int")
    got = ordered.first_rows(df, F.col("g") * 25 + 10, ["a", "b", "i"], ("g",)).collect()
    want = [r for g in (0, 1, 2) for r in sorted(r for r in rows if r[0] == g)[: g * 25 + 10]]
    assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, ordered.first_rows(df, F.lit(1000), ["a", "b", "i"], ("g",)).collect())) == sorted(rows)


# ---- intervals


def test_points_and_overlaps(spark):
    rng = random.Random(7)
    ranges = [(n, lo, lo + rng.choice([0, 1, 2, 5, 64, 100, 1000, 30_000])) for n, lo in enumerate(rng.randrange(-500, 2000) for _ in range(80))]
    points = [(i, rng.randrange(-600, 2500)) for i in range(300)]
    r, p = spark.createDataFrame(ranges, "n int, lo int, hi int"), spark.createDataFrame(points + [(999, None)], "i int, x int")
    got = sorted((x["i"], x["n"]) for x in intervals.point_join(p, r, "x").collect())
    assert got == sorted((i, n) for i, x in points for n, lo, hi in ranges if lo <= x < hi)
    b = r.toDF("m", "from", "to")
    pairs = sorted((x["n"], x["m"]) for x in intervals.overlap_join(r, b, ("lo", "hi"), ("from", "to")).collect())
    assert pairs == sorted((n, m) for n, a, c in ranges for m, d, e in ranges if max(a, d) < min(c, e))
    assert {x["x"] for x in intervals.missed(p, r, "x").collect()} == {x for _, x in points if not any(lo <= x < hi for _, lo, hi in ranges)}


def test_no_row_for_each_key(spark):
    """A range as wide as all integers is a row or two."""
    wide = spark.createDataFrame([(0, -(2**61), 2**61)], "n int, lo long, hi long")
    points = spark.range(1000)
    assert intervals.point_join(points, wide, "id").count() == 1000
