from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import common, mixing

from ..conftest import SF
from .helpers import odd_documents, prose, table


def plain_targets(sizes):
    """Caps one after another until none is exceeded."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s: 3.0 * sizes[s] for s in free if got[s] > 3 * sizes[s]}
        if not over:
            return {**fixed, **got}
        fixed |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30}, {"a": 1000, "b": 1, "c": 2, "d": 3, None: 5}, {"a": 7}, {"a": 0, "b": 0}, {f"s{i}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def corpus():
    return [(i, prose(i, 1 + (i * 37) % 90), "en", f"s{i % 5 if i % 3 else 0}") for i in range(900)]


def test_mix(spark):
    docs = table(spark, corpus())
    rows = mixing.mix(docs).collect()
    source = {i: s for i, _, _, s in corpus()}
    want = plain_targets(Counter({s: n for s, n in ((s, sum(len(t.split()) for _, t, _, x in corpus() if x == s)) for s in set(source.values()))}))
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
    assert len(rows) == 900 and all(abs(target[s] - want[s]) < 1e-6 for s in want)
    assert all(abs(taken[s] - want[s]) <= 0.005 * want[s] + 2 for s in want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_documents_follow_the_mix(spark):
    docs = table(spark, corpus())
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    got = Counter(r["doc_id"] for r in mixing.mix_documents(docs).collect())
    assert got == Counter({i: n for i, n in want.items() if n})


def test_chances_follow_expectations(spark):
    """Pareto keys: over many documents of one source, each size class is taken about as often as expected."""
    rows = [(i, "w " * (4 if i % 2 else 64), "en", "a" if i < 6000 else "b") for i in range(9000)]
    docs = table(spark, rows)
    m = mixing.Mix(docs)
    e = {(r["source"], r["cls"]): r["e"] for r in m.expected.collect()}
    n, total = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        key = ("a" if r["doc_id"] < 6000 else "b", r["size"].bit_length())
        total[key] += r["taken"] // r["size"]
        n[key] += 1
    assert all(abs(total[k] / n[k] - e[k]) < 0.05 for k in n)
    assert e[("a", 7)] > e[("a", 3)]


def test_crossing_equals_a_plain_scan(spark):
    """The range in which a running sum exceeds its limit, for a null source and for limits that are never met, too."""
    rng = np.random.default_rng(8)
    data = {s: sorted((int(r), int(rng.integers(1, 90)), int(rng.integers(1, 4))) for r in rng.choice(mixing.RANGES, n, replace=False)) for s, n in (("a", 3000), (None, 40), ("c", 1), ("d", 500))}
    ranges = spark.createDataFrame([(s, *row) for s, own in data.items() for row in own], "source string, range int, words long, n long")
    for column, at in (("words", 1), ("n", 2)):
        limits = {s: float(sum(row[at] for row in own) * f) for (s, own), f in zip(data.items(), (0.4, 0.99, -1, 1))}
        want = set()
        for s, own in data.items():
            words = n = 0
            for r, w, k in own:
                if (words + w if at == 1 else n + k) > limits[s]:
                    want.add((s, r, limits[s], words, n + k))
                    break
                words, n = words + w, n + k
        frame = spark.createDataFrame(list(limits.items()), "source string, limit double")
        got = mixing._crossing(common.Scratch(spark), ranges, frame, column).select("source", "range", "limit", "words_before", "n_upto")
        assert {tuple(r) for r in got.collect()} == want and len(want) == 3


def plain_mix(rows, strict):
    """taken of each (doc_id, text, lang, source) row by plain Python, given the draws."""
    import math

    size = {r[0]: len((r[1] or "").split()) for r in rows}
    by_source = defaultdict(list)
    for i, _, _, s in rows:
        by_source[s].append(i)
    want = plain_targets({s: sum(size[i] for i in ids) for s, ids in by_source.items()})
    taken = {}
    for s, ids in by_source.items():
        tilt = {i: 1 + mixing.TILT * (size[i].bit_length() if size[i] else 0) for i in ids}
        lo, hi = 0.0, 1e9
        for _ in range(200):  # the factor whose expected words are the target
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(min(3, mid * tilt[i]) * size[i] for i in ids) > want[s] else (mid, hi)
        e = {i: min(3.0, hi * tilt[i]) for i in ids}
        e = {i: float(round(x)) if abs(x - round(x)) < 1e-7 else x for i, x in e.items()}
        left = want[s] - sum(math.floor(e[i]) * size[i] for i in ids)
        ranked = sorted((DRAWS[i] / (1 - DRAWS[i]) * (1 - (p := e[i] - math.floor(e[i]))) / p, i) for i in ids if e[i] > math.floor(e[i]) and size[i])
        extra, sums = set(), [0]
        for _, i in ranked:
            sums.append(sums[-1] + size[i])
        if strict:
            extra = {i for _, i in ranked[: min(range(len(sums)), key=lambda k: (abs(sums[k] - left), k))]}
        else:  # in rank order until one does not fit: the rest depends on how many more are looked at
            extra = {i for k, (_, i) in enumerate(ranked) if sums[k + 1] <= left}
        for i in ids:
            taken[i] = math.floor(e[i]) * size[i], i in extra
    return taken


DRAWS: dict = {}


def test_mix_equals_plain(spark):
    """Whole copies and Pareto ranks against plain Python: all rows of a strict sample; of the other those before the first that does not fit."""
    rows = corpus() + [(2000 + i, prose(i, 40), "en", None) for i in range(60)] + [(3000, None, "en", "s1"), (3001, "", "en", "s2")]
    docs = table(spark, rows)
    u = (F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    DRAWS.update({r["doc_id"]: r["u"] for r in mixing._sized(docs).select("doc_id", u.alias("u")).collect()})
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    strict = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, strict=True).collect()}
    assert strict == {i: whole + size[i] * extra for i, (whole, extra) in plain_mix(rows, True).items()}
    plain = plain_mix(rows, False)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    assert set(got) == set(plain)
    assert all(got[i] == whole + size[i] for i, (whole, extra) in plain.items() if extra)
    assert all(got[i] in (whole, whole + size[i]) for i, (whole, _) in plain.items())


def test_odd_rows(spark):
    docs = table(spark, odd_documents()).withColumn("target", F.lit("clash"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd_documents()) and all(r["taken"] == 0 for r in rows if not r["size"])
    assert mixing.mix_documents(docs).columns == docs.columns
    empty = table(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    assert mixing.mix(table(spark, [(1, None, "en", "x"), (2, "", None, None)])).count() == 2


def test_repeated_rows_are_drawn_together(spark):
    """Rows of one doc_id (or none) and text are all taken alike, and are one row where rows are ordered."""
    rows = corpus()[:200] + [(None, prose(5, 30), "en", "s0")] * 40 + [(7000, prose(6, 30), "en", "s1")] * 3
    docs = table(spark, rows)
    m = mixing.Mix(docs)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and len({r["taken"] for r in got if r["doc_id"] is None}) == 1 and len({r["taken"] for r in got if r["doc_id"] == 7000}) == 1
    copies = Counter(r["doc_id"] for r in mixing.mix_documents(docs).collect())
    assert sum(copies.values()) == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert m.picked.count() == m.picked.distinct().count()


def test_query(spark):
    assert mixing.op3_mixing(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
