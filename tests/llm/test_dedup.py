import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import common, exact_dedup, mixing, pieces, quality, simhash

from ..conftest import SF
from .helpers import odd_documents, prose, table


def plain_classes(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for body, own in groups.items():
        best = min(own, key=lambda x: (x[0], x[1], x[2] or 0))
        done = False
        for x in own:
            kept = x == best and not done
            done |= kept
            out.append((x[2], best[2], len(own), kept, hashlib.sha256(body.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("digest_len", [32, 1, 0])
def test_exact_equals_plain(spark, digest_len):
    """Short digests collide, so the byte check has to tell the texts apart."""
    rows = odd_documents() + [(100 + i, prose(i % 23, 5) + " " * (i % 3), "en", "x") for i in range(120)]
    got = exact_dedup.exact_dedup(table(spark, rows), digest_len=digest_len).collect()
    assert Counter(tuple(r) for r in got) == plain_classes(rows)


def test_exact_hot_class_is_salted(spark):
    rows = [(i, "same text" + " " * (i % 2), "en", "x") for i in range(2500)] + [(9000, "other", "en", "x")]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert sum(r["kept"] for r in got) == 2 and {r["group_size"] for r in got} == {2500, 1}


def test_hot_keys_are_not_shuffled(spark, monkeypatch):
    """A class of half the rows meets its row by a broadcast of few keys; its texts are compared in each task first."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(i, "same text" + " " * (i % 2), "en", "x") for i in range(2000)] + [(5000 + i, prose(i, 5), "en", "x") for i in range(2000)]
    docs = table(spark, rows).repartition(4)
    classes = spark.createDataFrame([(1, 2000), (2, 60), (3, 1)], "k int, members long")
    assert [r["k"] for r in classes.where(common.hot(classes, "members", 4000)).collect()] == [1, 2]
    keyed = spark.range(2061).select(F.when(F.col("id") < 2000, 1).when(F.col("id") < 2060, 2).otherwise(3).alias("k"))
    joined = common.with_key(keyed, classes, "k", "members", 2061)
    assert Counter(r["members"] for r in joined.collect()) == {2000: 2000, 60: 60, 1: 1}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2
    got = exact_dedup.exact_dedup(docs)
    assert Counter(tuple(r) for r in got.collect()) == plain_classes(rows)
    found = common.Scratch(spark)
    digests = found.save(exact_dedup.digests(docs), "digests")
    classes = found.save(exact_dedup._grouped(digests), "classes")
    assert exact_dedup._mixed(found, docs, common.with_key(digests, classes, "key", "members", 4000), classes, 4000, 32).isEmpty()
    spans = spark.read.parquet(f"{found.base}/spans")
    hot = classes.where("members > 50").join(spans, "key")
    assert 1 <= hot.count() <= 4  # one row for each task that read copies


def test_repeated_rows_of_one_class(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(7, "same text", "en", "x")] * 40 + [(None, "no id", "en", "x")] * 20 + [(8, "same text", "en", "x")]
    for digest_len in (32, 0):
        got = exact_dedup.exact_dedup(table(spark, rows), digest_len=digest_len).collect()
        assert Counter(tuple(r) for r in got) == plain_classes(rows)


def test_exact_empty_and_clashing_columns(spark):
    empty = table(spark, [])
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0
    clash = table(spark, odd_documents()).withColumn("keep_id", F.lit(1)).withColumn("key", F.lit("k")).withColumn("kept", F.lit(True))
    assert exact_dedup.exact_dedup(clash).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.drop_duplicates(clash).columns == clash.columns


CLASHING = ("__of", "__want", "__WORD", "__bits", "__sha", "__n", "__nth", "__id", "__copies", "__row", "size", "h", "a.b", "count")


@pytest.mark.parametrize("operator", [simhash.near_duplicates, pieces.encode_decode, quality.quality, mixing.mix, exact_dedup.exact_dedup])
def test_clashing_columns_are_ignored(spark, operator):
    """Columns that are named like an operator's own change nothing, and results have the documented columns only."""
    docs = table(spark, odd_documents())
    got = operator(docs.withColumns({c: F.lit(c) for c in (*CLASHING, "fp", "key", "uid", "n_tokens", "kept", "target", "component_id")}))
    want = operator(docs)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("stage", [exact_dedup.drop_duplicates, simhash.drop_near_duplicates, mixing.mix_documents, quality.clean_documents])
def test_extra_columns_come_through(spark, stage):
    """Columns that are named like an operator's own keep their values."""
    docs = table(spark, odd_documents() + [(20, prose(3, 80) + ".", "en", "x")])
    plain = sorted(stage(docs).select("doc_id", "text").collect(), key=str)
    got = stage(docs.withColumns({c: F.lit(c) for c in CLASHING}))
    assert got.columns == [*docs.columns, *CLASHING]
    rows = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == [tuple(r) for r in plain] and plain
    assert all(tuple(r)[-len(CLASHING) :] == CLASHING for r in rows)


def test_exact_drop(spark):
    rows = odd_documents()
    left = exact_dedup.drop_duplicates(table(spark, rows)).collect()
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in left]
    assert len(bodies) == len(set(bodies)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows})


def test_snapshot_and_batches(spark):
    """A batch against a snapshot gives what all rows at once give."""
    rows = [(i, prose(i % 7, 4), "en", "x") for i in range(60)]
    for cond in (F.col("doc_id") < 30, F.lit(False), F.lit(True)):
        got = exact_dedup.exact_dedup(table(spark, rows), in_snapshot=cond).collect()
        assert Counter(tuple(r) for r in got) == plain_classes(rows)


def test_batch_larger_than_the_snapshot(spark, monkeypatch):
    """Its keys are dealt out to copies of the one filter."""
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 16)
    scratch = common.Scratch(spark)
    rows = [(i, prose(i, 4), "en", "x") for i in range(200)]
    digests = exact_dedup.digests(table(spark, rows))
    snapshot = exact_dedup.build_snapshot(scratch, digests.where("doc_id < 10"))
    assert snapshot.buckets == 1
    flags = exact_dedup.screen(scratch.save(exact_dedup._grouped(digests), "grouped"), snapshot).collect()
    assert len(flags) == 200 and {r["best"]["doc_id"] for r in flags if r["hit"]} >= set(range(10)) and sum(r["hit"] for r in flags) < 20
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(table(spark, rows), in_snapshot=F.col("doc_id") < 3).collect()) == plain_classes(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_fuse_filter(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    filt = exact_dedup.build_fuse(keys)
    assert exact_dedup.in_fuse(filt, keys).all()
    others = np.random.default_rng(n + 1).integers(0, 2**64, 100_000, dtype=np.uint64)
    assert exact_dedup.in_fuse(filt, others).sum() < 20
    if n >= 60_000:
        assert len(filt["prints"]) / 2 < 1.35 * n


def test_screen_loses_none(spark):
    docs = table(spark, odd_documents() + [(i, "t", "en", "x") for i in range(1000, 1400)])
    ids = docs.where("doc_id % 3 = 0 OR doc_id IS NULL").select("doc_id").distinct()
    maybe, rest = common.screened(docs, ids)
    assert maybe.count() + rest.count() == docs.count()
    assert rest.where("doc_id % 3 = 0 OR doc_id IS NULL").count() == 0 and rest.count() > 200


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: (doc_id, fingerprint) rows; the smallest id of each row's component."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in fps)


def test_near_equals_plain(spark):
    rows = odd_documents() + [(200 + i, prose(i % 30, 60) + (" tail" if i % 2 else ""), "en", "x") for i in range(150)]
    want = plain_components([(i, plain_fingerprint(t)) for i, t, *_ in rows])
    assert Counter(tuple(r) for r in simhash.near_duplicates(table(spark, rows)).collect()) == want


def test_query_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in docs])
    assert Counter(tuple(r) for r in simhash.op9_simhash(spark, SF).collect()) == want


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_links_join_what_all_pairs_join(spark, monkeypatch, width):
    """Dense clouds of fingerprints, so that lists are cut into tiles; every width of the index gives the same."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    fps = set()
    for centre in rng.integers(0, 2**64, 6, dtype=np.uint64):
        for _ in range(60):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    distinct = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(sorted(fps))], "fp long, first_id long")
    scratch = common.Scratch(spark)
    roots = simhash.components(scratch, simhash.links(scratch, distinct, width)).collect()
    of = {r["node"] & (2**64 - 1): r["root"] for r in roots}
    want = plain_components([(i, f) for i, f in enumerate(sorted(fps))])
    by_id = {i: c for i, _, c in want}
    ids = {f: i for i, f in enumerate(sorted(fps))}
    groups = {}
    for f in fps:
        groups.setdefault(by_id[ids[f]], set()).add(of.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(common.Scratch(spark), edges).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and roots[100] == roots[101] != roots[0]


@pytest.mark.parametrize("width, n", [(1, 5), (2, 7), (3, 20), (4, 70)])
def test_cover(width, n):
    from itertools import combinations

    sets = simhash.cover(width)
    assert len(sets) == n and all(len(t) == width for t in sets)
    assert all(any(set(t) <= set(four) for t in sets) for four in combinations(range(8), 4))


def plain_near_drop(rows):
    """Positions of the rows that stay: of each component the smallest doc_id, then the least text, then the first."""
    fps = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    distinct = sorted({f for _, f in fps})
    comp = {f: f for f in distinct}
    changed = True
    while changed:
        changed = False
        for a in distinct:
            for b in distinct:
                if bin(a ^ b).count("1") <= 4 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    best = {}
    for at, ((i, t, *_), (_, f)) in enumerate(zip(rows, fps)):
        key = (i is None, i or 0, t is None, t or "")
        if comp[f] not in best or key < best[comp[f]][0]:
            best[comp[f]] = key, at
    return Counter((rows[at][0], rows[at][1]) for _, at in best.values())


def test_near_drop(spark):
    rows = [(i, prose(i % 5, 80), "en", "x") for i in range(20)] + [(None, prose(1, 80), "en", "x"), (3, prose(99, 80), "en", "x"), (None, prose(50, 80), "en", "x"), (None, prose(50, 80) + " more", "en", "x"), (7, prose(2, 80) + " end", "en", "x")]
    rows += odd_documents()
    left = simhash.drop_near_duplicates(table(spark, rows))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == plain_near_drop(rows)
    assert (3, prose(99, 80)) in plain_near_drop(rows)  # shares an id, and nothing else, with a row that stays
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.drop_near_duplicates(table(spark, [])).count() == 0 and simhash.near_duplicates(table(spark, [])).count() == 0


def test_rows_without_an_id_meet_nowhere(spark):
    """Half of the rows lack a doc_id: they stay where they are, whatever the joins."""
    docs = table(spark, [(i if i % 2 else None, f"text {i}", "en", "x") for i in range(4000)]).repartition(8)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for with_null in (True, False):
            ids = spark.createDataFrame([(i,) for i in range(1, 400)] + [(None,)] * with_null, "doc_id long")
            inside, outside = common.parted(docs, ids)
            count = lambda df: (df.where("doc_id IS NULL").count(), df.where("doc_id IS NOT NULL").count())
            assert (count(inside), count(outside)) == (((2000, 200), (0, 1800)) if with_null else ((0, 200), (2000, 1800)))
            most = max(r["count"] for df in (inside, outside) for r in df.groupBy(F.spark_partition_id()).count().collect())
            assert most < 1000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_half_of_all_rows_in_one_component(spark, monkeypatch):
    """A chain of fingerprints holds half of the rows; every row gets its component, and the large root is not shuffled."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rng = np.random.default_rng(3)
    chain = [int(rng.integers(0, 1 << 62))]
    while len(chain) < 400:
        chain.append(chain[-1] ^ (7 << int(rng.integers(0, 59))))
    lone = [int(x) for x in rng.integers(0, 1 << 62, 400)]
    prints = spark.createDataFrame([(1000 + i, simhash._signed(f)) for i, f in enumerate(chain)] + [(i, simhash._signed(f)) for i, f in enumerate(lone)], "doc_id long, fp long")
    seen, plain = [], simhash.with_key
    monkeypatch.setattr(simhash, "with_key", lambda rows, per, key, members, total: (seen.append((key, per.where(common.hot(per, members, total)).count())), plain(rows, per, key, members, total))[1])
    named = simhash._named(common.Scratch(spark), prints, simhash.WIDTH)
    got = {r["fp"]: r["component_id"] for r in named.collect()}
    assert {got[simhash._signed(f)] for f in chain} == {1000} and ("root", 1) in seen
    assert len({got[simhash._signed(f)] for f in lone}) == 400


def test_a_snapshot_is_stored_and_opened_again(spark, tmp_path, monkeypatch):
    """Batches against a stored snapshot: new texts go by the filter, changed classes by their bucket, whose folders alone are read."""
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 16)
    old = [(i, prose(i % 150, 4), "en", "x") for i in range(300)]
    exact_dedup.write_snapshot(exact_dedup.build_snapshot(common.Scratch(spark), exact_dedup.digests(table(spark, old))), str(tmp_path / "snap"))
    snapshot = exact_dedup.open_snapshot(spark, str(tmp_path / "snap"))
    assert snapshot.buckets == 10 and snapshot.classes.count() == 150
    asked, held = [], exact_dedup._held
    monkeypatch.setattr(exact_dedup, "_held", lambda snap, buckets: (asked.append(held(snap, buckets)), asked[-1])[1])
    new = [(1000, prose(3, 4) + "  ", "en", "x"), (1001, prose(3, 4), "en", "x"), (1002, "never seen before", "en", "x"), (1003, None, "en", "x")]
    got = {r["key"]: (r["members"], r["best"]["doc_id"], r["is_new"]) for r in exact_dedup.ingest_changes(common.Scratch(spark), snapshot, exact_dedup.digests(table(spark, new))).collect()}
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).digest()
    assert {bytes(k): v for k, v in got.items()} == {sha(prose(3, 4)): (4, 1000, False), sha("never seen before"): (1, 1002, True), sha(None): (1, 1003, True)}
    assert len(asked[0].inputFiles()) >= 1 and asked[0].select("bucket").distinct().count() <= 3
    plan = asked[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan), plan
    nothing = exact_dedup.open_snapshot(spark, str(tmp_path / "snap"))
    assert exact_dedup.ingest_changes(common.Scratch(spark), nothing, exact_dedup.digests(table(spark, []))).count() == 0
