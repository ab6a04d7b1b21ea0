"""Draws: joint frequencies of keyed uniforms, and what alias tables draw."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewater.functions.numbers import uniform
from tidewater.operators import alias, planner, versions


def chi_square(counts, cells, total):
    """Deviations of a chi-square statistic from its mean."""
    expected = total / cells
    stat = sum((counts.get(c, 0) - expected) ** 2 / expected for c in range(cells))
    return (stat - (cells - 1)) / math.sqrt(2 * (cells - 1))


@pytest.mark.parametrize("pair", ["next counter", "next key", "both"])
def test_pairs_of_draws_are_independent(spark, pair):
    n, a = 40_000, F.col("id")
    other = {"next counter": uniform(a, F.lit(1)), "next key": uniform(a + 1, F.lit(0)), "both": uniform(a + 7, a)}[pair]
    cell = F.floor(uniform(a, F.lit(0)) * 16) * 16 + F.floor(other * 16)
    counts = {r[0]: r[1] for r in spark.range(n).groupBy(cell.alias("c")).count().collect()}
    assert abs(chi_square(counts, 256, n)) < 5


def test_subsets_without_replacement_are_all_drawn(spark):
    """3 of 8 equal keys, 20,000 times: each of the 56 subsets has its share."""
    n = 20_000
    items = spark.range(n * 8).select((F.col("id") / 8).cast("long").alias("g"), (F.col("id") % 8).cast("int").alias("k"), F.lit(1.0).alias("weight"))
    drawn = planner.sample_without_replacement(items, 3, uniform(F.col("g"), F.col("k")), by=("g",))
    found = Counter(tuple(r[0]) for r in drawn.groupBy("g").agg(F.sort_array(F.collect_list("k")).alias("s")).select("s").collect())
    names = list(combinations(range(8), 3))
    assert set(found) == set(names)
    assert abs(chi_square({i: found[s] for i, s in enumerate(names)}, 56, n)) < 5


def test_requests_draw_plans_of_their_own(spark):
    """Requests of one tick with equal keys: as many different plans as independent draws give."""
    requests = spark.range(3000).select(F.lit(1).alias("t"), F.col("id").alias("request"), F.lit(0.0).alias("hot_mass"), F.col("id").alias("seed"))
    keys = spark.range(20).select(F.col("id").cast("int").alias("k"), F.lit(0.05).alias("prob"))
    hot = spark.createDataFrame([], "t int, k int, weight double")
    plans = planner.request_plans(requests, keys, hot, 6).groupBy("request").agg(F.sort_array(F.collect_list("k")).alias("s"))
    found = {tuple(r["s"]) for r in plans.collect()}
    expected = 38_760 * (1 - (1 - 1 / 38_760) ** 3000)
    assert abs(len(found) - expected) < 60 and all(len(set(s)) == 6 for s in found)


def weights(kind, n, rng):
    return {"equal": [3] * n, "none": [0] * n, "one": [0] * (n - 1) + [9], "mixed": [rng.choice([0, 1, 1, 2, 50, 1000]) for _ in range(n)], "odd": [None, -5, 7] + [rng.randrange(100) for _ in range(n - 3)]}[kind]


@pytest.mark.parametrize("parts", [1, 6])
def test_tables_give_each_item_its_weight(spark, parts):
    rng = random.Random(8)
    rows = [(g, k, w) for g, kind in enumerate(("equal", "none", "one", "mixed", "odd")) for k, w in enumerate(weights(kind, 3 + 40 * (kind != "one"), rng))]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = alias.alias_table(spark.createDataFrame(rows, "g int, k int, weight long"), by=("g",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in range(5):
        own, slots = {k: max(0, w or 0) for h, k, w in rows if h == g}, [r for r in table if r["g"] == g]
        if not sum(own.values()):
            own = dict.fromkeys(own, 1)
        total = sum(own.values())
        assert sorted(r["slot"] for r in slots) == list(range(len(own))) and {r["k"] for r in slots} == set(own)
        parts_of = Counter()
        for r in slots:
            assert 0 <= r["keep"] <= total == r["total"]
            parts_of[r["k"]] += r["keep"]
            parts_of[r["alias"]] += total - r["keep"]
        assert {k: v for k, v in parts_of.items() if v} == {k: w * len(own) for k, w in own.items() if w}


def test_draws_follow_the_weights(spark):
    items = spark.createDataFrame([(k, w) for k, w in enumerate([1, 0, 4, 10, 85, 100])], "k int, weight long")
    n = 40_000
    drawn = alias.alias_draw(spark.range(n), alias.alias_table(items), uniform(F.col("id"), F.lit(1)), uniform(F.col("id"), F.lit(2)))
    counts = {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()}
    assert sum(counts.values()) == n and 1 not in counts
    stat = sum((counts[k] - n * w / 200) ** 2 / (n * w / 200) for k, w in ((0, 1), (2, 4), (3, 10), (4, 85), (5, 100)))
    assert stat < 25
    with pytest.raises(ValueError, match="larger unit"):
        alias.alias_table(spark.createDataFrame([(1, 2**61), (2, 2**60)], "k int, weight long"))


def test_versions_go_back_as_often_as_asked(spark):
    log = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, None), (5, None), (6, 13), (7, None), (8, 14)], "since long, version long")
    got = [tuple(r) for r in versions.validity(log).orderBy("since").collect()]
    assert got == [(1, 10, 2), (2, 11, 3), (3, 12, 4), (4, 11, 5), (5, 10, 6), (6, 13, 7), (7, 10, 8), (8, 14, None)]
    with pytest.raises(ValueError, match="nothing to go back to at 2"):
        versions.validity(spark.createDataFrame([(1, 1), (2, None), (3, 5)], "since long, version long"))


def test_work_without_a_slice_is_not_lost(spark):
    log = spark.createDataFrame([(5, 1), (10, 2)], "since long, version long")
    slices = spark.createDataFrame([(1, 1, 0, 10, 2.0, 0), (1, 2, 0, 10, 6.0, 1), (2, 1, 0, 5, 1.0, 3)], "version long, slice_id long, lo long, hi long, size double, server int")
    work = spark.createDataFrame([(1, 3, 4.0), (6, 3, 4.0), (12, 3, 4.0), (12, 7, 8.0)], "t long, k long, cost double")
    got = {(r["t"], r["version"], r["server"]): r["work"] for r in versions.routed(work, log, slices, "t", "k", "cost").collect()}
    assert got == pytest.approx({(1, None, None): 4.0, (6, 1, 0): 1.0, (6, 1, 1): 3.0, (12, 2, 3): 4.0, (12, 2, None): 8.0})
