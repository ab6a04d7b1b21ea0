"""Operator 1: exact dedup against immutable snapshots.

A snapshot holds one row per class of equal texts and, per bucket of the digest space, a static binary-fuse filter.
Incoming rows are first grouped among themselves by digest (new-batch duplicates; a hot text becomes one row before
anything is shuffled by bucket), then screened by the filter of their bucket. What the filter rejects is new. What
it lets through joins the snapshot's exact bucket, and the bytes of all texts that share a digest are compared: within
each task, then for each class (a hot class in up to SALTS parts first), so that copies of a text are not shuffled.

Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row with the
most code points in the original text stays, then the one with the smallest doc_id (null last); of fully repeated
rows exactly one. Texts of any length are compared whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, bounded, code_points, columns, documents, fresh, hot, null_safe, parted, rows, screened, table, with_key, without

#: Snapshot keys in one filter, and parts in which the texts of a hot class are compared.
BUCKET_KEYS, SALTS = 65_536, 256


# ---- static binary-fuse filter (3-wise, 16-bit fingerprints), vectorised over keys


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _slots(h: np.ndarray, length: int, count: int) -> np.ndarray:
    """Three slots of each hash, in three consecutive segments."""
    with np.errstate(over="ignore"):
        start = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64) * length
        mask = np.uint64(length - 1)
        a = start + (h & mask).astype(np.int64)
        b = start + length + ((h >> np.uint64(18)) & mask).astype(np.int64)
        c = start + 2 * length + (_mix(h, 7) & mask).astype(np.int64)
    return np.stack([a, b, c])


def _print16(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32)) ^ (h >> np.uint64(16))) & np.uint64(0xFFFF)).astype(np.uint16)


def build_fuse(keys: np.ndarray) -> dict:
    """Filter over distinct uint64 keys: every key is found, another one with a chance of 2**-16."""
    n = len(keys)
    length = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 2, 18))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, int(np.ceil(n * factor / length)) - 1)
    for seed in range(1, 200):
        size = (count + 2) * length
        h = _mix(keys, seed)
        at = _slots(h, length, count)
        degree = np.bincount(at.ravel(), minlength=size)
        total = np.bincount(at.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
        rounds, left, frontier = [], n, np.flatnonzero(degree == 1)
        while len(frontier):
            slot = frontier[degree[frontier] == 1]
            key, first = np.unique(total[slot], return_index=True)
            slot = slot[first]
            if not len(key):
                break
            rounds.append((key, slot))
            left -= len(key)
            touched = at[:, key]
            np.subtract.at(degree, touched.ravel(), 1)
            np.subtract.at(total, touched.ravel(), np.tile(key, 3))
            frontier = np.unique(touched)
        if left == 0:
            prints, own = np.zeros(size, np.uint16), _print16(h)
            for key, slot in reversed(rounds):
                s = at[:, key]
                prints[slot] = 0
                prints[slot] = own[key] ^ prints[s[0]] ^ prints[s[1]] ^ prints[s[2]]
            return {"seed": seed, "length": length, "count": count, "prints": prints.tobytes()}
        count += 1 + count // 16
    raise RuntimeError("no seed peels these keys; are they distinct?")


def in_fuse(filt: dict, keys: np.ndarray) -> np.ndarray:
    h = _mix(keys, int(filt["seed"]))
    prints = np.frombuffer(filt["prints"], np.uint16)
    s = _slots(h, int(filt["length"]), int(filt["count"]))
    return (prints[s[0]] ^ prints[s[1]] ^ prints[s[2]]) == _print16(h)


# ---- digests


def _digest(digest_len: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("key", pa.binary()), ("n_cp", pa.int64()), ("body" if with_text else "sha", pa.binary())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in rows(batch, "text"):
                body = (text or b"").translate(None, SPACES)
                sha = hashlib.sha256(body).digest()
                out.append((doc_id, sha[:digest_len], code_points(text or b""), body if with_text else sha))
                if with_text and len(out) >= 256:
                    yield table(schema, out)
                    out = []
            yield table(schema, out)

    return run


def digests(docs: DataFrame, digest_len: int = 32) -> DataFrame:
    """doc_id, key (the digest that classes go by), n_cp, sha: one narrow row per document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(_digest(digest_len, False), "doc_id long, key binary, n_cp long, sha binary")


def _grouped(df: DataFrame) -> DataFrame:
    """One row per key: members and the row that stays."""
    # the longest text, then the smallest doc_id, then none, as one number: so that groups are hashed and not sorted
    whole = lambda c: c.cast("decimal(38,0)")
    order = F.when(F.col("doc_id").isNull(), F.lit(Decimal(1 << 65))).otherwise(whole(F.col("doc_id")))
    order = whole(order) - whole(F.col("n_cp").cast("decimal(12,0)") * F.lit(Decimal(1 << 67)))
    grouped = df.withColumn("order", whole(order)).groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("n_cp").alias("n"), F.min_by("doc_id", "order").alias("id"))
    best = F.struct((-F.col("n")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("doc_id"))
    return grouped.select("key", "members", best.alias("best"))


# ---- snapshots


@dataclass
class Snapshot:
    classes: DataFrame  # key, members, best, bucket
    filters: DataFrame  # bucket, seed, length, count, prints
    buckets: int


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long")


def _key64(keys: pd.Series) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little") for k in keys], np.uint64)


def build_snapshot(scratch: Scratch, rows_: DataFrame) -> Snapshot:
    """Freeze digest rows: their classes by bucket, and a filter per bucket of about BUCKET_KEYS keys."""
    classes = scratch.save(_grouped(rows_), "snapshot")
    buckets = max(1, -(-classes.count() // BUCKET_KEYS))
    classes = classes.withColumn("bucket", _bucket(buckets))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"bucket": pdf["bucket"].iloc[0], **build_fuse(np.unique(_key64(pdf["key"])))}])

    filters = classes.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket long, seed long, length long, count long, prints binary")
    return Snapshot(classes, scratch.save(filters, "filters"), buckets)


def screen(grouped: DataFrame, snapshot: Snapshot) -> DataFrame:
    """grouped with `hit`: false only for keys that the snapshot does not hold.

    A batch that is larger than the snapshot is dealt out: about BUCKET_KEYS of its keys meet one copy of a filter.
    """
    parts = max(1, -(-grouped.count() // (snapshot.buckets * BUCKET_KEYS)))

    def probe(new: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
        if new.empty:
            return pd.DataFrame({"key": pd.Series(dtype=object), "hit": pd.Series(dtype=bool)})
        hit = in_fuse(filt.iloc[0].to_dict(), _key64(new["key"])) if len(filt) else np.zeros(len(new), bool)
        return pd.DataFrame({"key": new["key"], "hit": hit})

    keys = grouped.select("key", _bucket(snapshot.buckets).alias("bucket"), F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int").alias("part"))
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    flags = keys.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInPandas(probe, "key binary, hit boolean")
    return grouped.join(flags, "key")


def ingest(scratch: Scratch, snapshot: Snapshot, incoming: DataFrame) -> DataFrame:
    """The classes after the incoming digest rows: key, members, best."""
    grouped = scratch.save(_grouped(incoming), "incoming")
    flags = scratch.save(screen(grouped, snapshot), "screened")
    old = snapshot.classes.select("key", F.col("members").alias("old_members"), F.col("best").alias("old_best"))
    positive = flags.where("hit").join(old, "key", "left")
    merged = positive.select("key", (F.col("members") + F.coalesce("old_members", F.lit(0))).alias("members"), F.least("best", F.coalesce("old_best", "best")).alias("best"))
    kept = snapshot.classes.join(flags.where("hit"), "key", "left_anti").select("key", "members", "best")
    return merged.unionByName(flags.where("not hit").select("key", "members", "best")).unionByName(kept)


# ---- stored snapshots

_CLASSES = "key binary, members long, best struct<neg: long, no_id: boolean, doc_id: long>, bucket long"
_FILTERS = "bucket long, seed long, length long, count long, prints binary"


def write_snapshot(snapshot: Snapshot, folder: str) -> None:
    """A new folder with the classes by bucket, and the filters. It is never changed: later classes go to a snapshot of their own."""
    snapshot.classes.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/classes")
    snapshot.filters.withColumn("buckets", F.lit(snapshot.buckets)).write.parquet(f"{folder}/filters")


def open_snapshot(spark: SparkSession, folder: str) -> Snapshot:
    filters = spark.read.schema(f"{_FILTERS}, buckets int").parquet(f"{folder}/filters")
    first = filters.select("buckets").first()
    return Snapshot(spark.read.schema(_CLASSES).parquet(f"{folder}/classes"), filters.drop("buckets"), first["buckets"] if first else 1)


def _held(snapshot: Snapshot, buckets: list[int]) -> DataFrame:
    """The classes of some buckets; of a stored snapshot only their folders are read."""
    return snapshot.classes.where(F.col("bucket").isin(buckets)).select("key", "bucket", F.col("members").alias("old_members"), F.col("best").alias("old_best"))


def ingest_changes(scratch: Scratch, snapshot: Snapshot, incoming: DataFrame) -> DataFrame:
    """key, members, best of the classes that the incoming digest rows bring or change, and `is_new`.

    What the filters reject is new without a look at the snapshot; only the buckets of what they let through are read.
    """
    grouped = scratch.save(_grouped(incoming), "incoming")
    flags = scratch.save(screen(grouped, snapshot).withColumn("bucket", _bucket(snapshot.buckets)), "screened")
    buckets = [r["bucket"] for r in flags.where("hit").select("bucket").distinct().collect()]  # a number for BUCKET_KEYS classes
    both = flags.where("hit").join(_held(snapshot, buckets), ["bucket", "key"], "left")
    merged = both.select("key", (F.col("members") + F.coalesce("old_members", F.lit(0))).alias("members"), F.least("best", F.coalesce("old_best", "best")).alias("best"), F.col("old_best").isNull().alias("is_new"))
    return flags.where("not hit").select("key", "members", "best", F.lit(True).alias("is_new")).unionByName(merged)


def _bodies(docs: DataFrame, ids: DataFrame, digest_len: int) -> DataFrame:
    """doc_id, key, n_cp, body of the documents that may have one of the ids."""
    maybe, _ = screened(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)
    return maybe.transform(bounded).mapInArrow(_digest(digest_len, True), "doc_id long, key binary, n_cp long, body binary")


def _mixed(scratch: Scratch, docs: DataFrame, classed: DataFrame, classes: DataFrame, total: int, digest_len: int) -> DataFrame:
    """Byte check: the keys whose texts are not all the same."""
    ids = scratch.save(classed.where("members > 1").select("doc_id").distinct(), "multi_ids")
    large = classes.where(hot(classes, "members", total)).select("key")
    bodies = _bodies(docs, ids, digest_len).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    bodies = bodies.join(F.broadcast(large.withColumn("hot", F.lit(True))), "key", "left").withColumn("part", F.when(F.col("hot"), F.col("part")).otherwise(0))
    # all texts of a class are the same if the least is the greatest; copies within a task go into one row before the shuffle
    spans = scratch.save(bodies.groupBy("key", "part").agg(F.min("body").alias("least"), F.max("body").alias("most")), "spans")
    several = spans.join(F.broadcast(large), "key").groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found = spans.select("key", "least", "most").unionByName(several).where("least <> most").select("key").distinct()
    return scratch.save(found, "mixed")


def exact_dedup(docs: DataFrame, in_snapshot=None, digest_len: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per document.

    in_snapshot: a condition on doc_id; its rows were there before (the snapshot), the others come in as a new batch.
    digest_len: bytes of SHA-256 that classes go by. Short ones collide; the byte check then tells texts apart.
    """
    scratch = Scratch(docs.sparkSession)
    in_snapshot = F.col("doc_id") % 2 == 0 if in_snapshot is None else in_snapshot
    all_rows = scratch.save(digests(docs, digest_len).withColumn("uid", F.monotonically_increasing_id()), "digests")
    total = all_rows.count()
    old = F.coalesce(in_snapshot, F.lit(False))
    snapshot = build_snapshot(scratch, all_rows.where(old))
    classes = scratch.save(ingest(scratch, snapshot, all_rows.where(~old)), "classes")
    scratch.drop("incoming", "screened", "filters", "snapshot")
    classed = scratch.save(with_key(all_rows, classes, "key", "members", total), "classed")
    mixed = _mixed(scratch, docs, classed, classes, total, digest_len)
    if not mixed.isEmpty():  # texts that share a digest: classes by all bytes
        ids = scratch.save(all_rows.join(mixed, "key", "left_semi").select("doc_id").distinct(), "mixed_ids")
        bodies = _bodies(docs, ids, digest_len).join(mixed, "key", "left_semi")
        bodies = scratch.save(bodies.withColumn("sha", F.unhex(F.sha2("body", 256))).distinct(), "bodies")
        same = null_safe(all_rows, bodies, ["doc_id", "key", "n_cp", "sha"])
        whole = F.struct(all_rows["key"], F.coalesce("body", F.lit(b"")).alias("body")).alias("key")
        all_rows = scratch.save(all_rows.join(bodies, same, "left").select(all_rows["doc_id"], whole, all_rows["n_cp"], all_rows["sha"], all_rows["uid"]), "regrouped")
        classes = scratch.save(_grouped(all_rows), "regrouped_classes")
        classed = scratch.save(with_key(all_rows, classes, "key", "members", total), "reclassed")
    scratch.drop("multi_ids", "spans", "mixed_ids", "bodies", "digests", "classes", "regrouped", "regrouped_classes")
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_cp") == -F.col("best.neg"))
    classed = classed.withColumn("kept", best)
    # of fully repeated rows the first stays
    firsts = classed.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first"))
    repeated = scratch.save(firsts.where("n > 1"), "repeated")
    if not repeated.isEmpty():
        chosen = with_key(classed.where("kept"), scratch.save(firsts, "firsts"), "key", "n", total)
        chosen = chosen.withColumn("kept", F.col("uid") == F.col("first")).select(classed.columns)
        classed = classed.where("NOT kept").unionByName(chosen)
    return classed.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("members").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without the copies, all columns.

    Decisions go by doc_id: rows that repeat a doc_id with another text stay if any of them stays; of fully repeated
    rows one stays. Rows without a doc_id go only if their text's class has another row that stays.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(exact_dedup(docs), "found")
    # a row goes unless its class keeps it; several rows under one id are told apart by their text
    per_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays"))
    plain = scratch.save(per_id.where("n = 1 AND NOT stays AND doc_id IS NOT NULL").select("doc_id"), "gone")
    mixed = scratch.save(per_id.where("n > 1 OR doc_id IS NULL").select("doc_id"), "mixed")
    if mixed.isEmpty():
        return without(docs, plain)
    several, rest = parted(docs, mixed)
    sha, n, uid = (fresh(docs, c) for c in ("__sha", "__n", "__uid"))
    body = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")
    several = several.withColumns({sha: F.sha2(body, 256), n: F.char_length(F.coalesce("text", F.lit(""))), uid: F.monotonically_increasing_id()})
    several = scratch.save(several, "several")
    first = several.groupBy(sha, "doc_id").agg(F.max(F.struct(n, (-F.col(uid)).alias("neg")))["neg"].alias("neg"))
    stay = found.where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    chosen = first.join(stay, first["doc_id"].eqNullSafe(F.col("k_id")) & (first[sha] == F.col("k_sha")), "left_semi").select((-F.col("neg")).alias(uid))
    return without(rest, plain).unionByName(several.join(chosen, uid, "left_semi").select(columns(docs)))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal texts: even doc_ids as the snapshot, the rest as the incoming batch."""
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n_cp
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS LAST)
"""
