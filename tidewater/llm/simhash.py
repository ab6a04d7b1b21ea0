"""Operator 9: SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is 64 majority bits of the XXH64 values of a text's 4-word shingles. Two fingerprints that differ in at
most 4 bits share at least 8 - 4 = 4 of their 8 positional bytes. The index has a posting list for each value of `width`
byte positions together: for each set of a cover, some set of which lies inside every four positions, so that each such
pair meets in at least one list. In a list the shared positional bytes of each pair are tallied, pairs that reach the
minimum are retained and their bits compared. Every width gives the same links: 1 has five lists a fingerprint, each of
1/256 of all, 2 has seven of 1/65,536, 3 (WIDTH) has 20 of 1/2**24, 4 has 70 of 1/2**32.

Equal fingerprints are one entry. A list of over TILE entries is cut into blocks that meet two at a time in tiles, so
that no task holds more than two blocks; a tile gives a spanning forest of its links, not all pairs. Links become
components by contraction rounds that are written to the shared folder.

Null, empty and blank texts have fingerprint zero and are linked like any other. component_id is the smallest non-null
doc_id reachable (null where there is none). Repeated rows and ties get the same fingerprint and component. Other
columns are ignored by near_duplicates() and kept by drop_near_duplicates(). Empty tables give empty results.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded, columns, documents, fresh, parted, rows, table, with_key, without

SHINGLE, SEED, MAX_BITS, TILE, WIDTH = 4, 42, 4, 4096, 3
MIN_SHARED = 8 - MAX_BITS
#: Shingles hashed at once.
BLOCK = 1 << 16


def cover(width: int) -> list[tuple[int, ...]]:
    """Sets of `width` of the positions 0..7, one inside every four positions, as few as there can be."""
    if width == 3:  # positions in three parts: triples inside a part, or two and one of the next
        part = [i % 3 for i in range(8)]
        wanted = {(0, 0, 0), (1, 1, 1), (2, 2, 2), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
        return [t for t in combinations(range(8), 3) if tuple(sorted(part[i] for i in t)) in wanted]
    if width == 2:  # of four positions two are in the same of three parts
        return [t for t in combinations(range(8), 2) if t[0] % 3 == t[1] % 3]
    return list(combinations(range(8), 4)) if width == 4 else [(i,) for i in range(5)]


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n < 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:to], starts[at + SHINGLE : to + SHINGLE])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    for batch in batches:
        yield table(schema, [(doc_id, _signed(fingerprint(text))) for doc_id, text in rows(batch, "text")])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(_fingerprints, "doc_id long, fp long")


# ---- links


def _postings(distinct: DataFrame, width: int) -> DataFrame:
    """fp under the keys of its lists: the set of the cover, then its bytes."""
    def key(number: int, positions: tuple[int, ...]):
        out = F.lit(number).cast("long")
        for i in positions:
            out = F.shiftleft(out, 8) + F.shiftright("fp", 8 * i).bitwiseAND(F.lit(255))
        return out

    return distinct.select(F.explode(F.array(*(key(*x) for x in enumerate(cover(width))))).alias("key"), "fp")


_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def _unshared(x: np.ndarray) -> np.ndarray:
    """Positions at which the bytes differ, from the XOR of two fingerprints."""
    return np.bitwise_count((((x & _LOW) + _LOW) | x) & ~_LOW)


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links within a posting list that join all that its verified pairs join, fewer than its entries."""
    comp, links, left = np.arange(len(fps)), [], len(fps) - 1
    for i in range(len(fps) - 1):
        if not left:
            break
        x = fps[i + 1 :] ^ fps[i]
        retained = np.flatnonzero((_unshared(x) <= 8 - MIN_SHARED) & (comp[i + 1 :] != comp[i]))
        for j in retained[np.bitwise_count(x[retained]) <= MAX_BITS] + i + 1:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                links.append((int(fps[i]), int(fps[j])))
                left -= 1
    return links


def _linked(batches):
    """Rows come sorted by list and tile."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest = np.empty((3, 0), np.int64)

    def groups(own, ends):
        found = []
        cuts = np.flatnonzero((own[0, 1:] != own[0, :-1]) | (own[1, 1:] != own[1, :-1])) + 1
        starts, stops = np.r_[0, cuts], np.r_[cuts, own.shape[1]]
        for s, e in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
            if e < own.shape[1] or ends:
                found += spanning_links(np.unique(own[2, s:e]).view(np.uint64))
        return table(schema, [(_signed(a), _signed(b)) for a, b in found]), (cuts[-1] if len(cuts) else 0)

    for batch in batches:
        own = np.concatenate([rest, [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]], axis=1)
        if own.shape[1]:
            out, last = groups(own, False)
            rest = own[:, last:]
            yield out
    if rest.shape[1]:
        yield groups(rest, True)[0]


def links(scratch: Scratch, distinct: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b: linked fingerprints, enough of them to join every component."""
    postings = _postings(distinct, width)
    large = postings.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("blocks"))
    large = scratch.save(large, "large")
    split = postings.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.least(o, own).cast("long") * F.col("blocks") + F.greatest(o, own)).cast("long"))
    split = split.select("key", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(tiles)).alias("tile"), "fp")
    return split.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_linked, "a long, b long").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, root: one root for each connected component of the edges (a, b).

    Each round points every node at its smallest neighbour, twice, and maps the edges along; edges inside one node go.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.save(both(edges.where("a <> b")), "edges0")
    roots = scratch.save(edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots0")
    n = 0
    while not edges.isEmpty():
        n += 1
        up = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("y"))
        up = scratch.save(up, f"up{n}")
        twice = up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", "z")
        twice = scratch.save(twice, f"twice{n}")
        to = lambda df, c: df.join(twice.withColumnRenamed("x", c), c, "left").withColumn(c, F.coalesce("z", c)).drop("z")
        edges = scratch.save(to(to(edges, "a"), "b").where("a <> b").select("a", "b").distinct(), f"edges{n}")
        roots = scratch.save(to(roots, "root").select("node", "root"), f"roots{n}")
        scratch.drop(f"edges{n - 1}", f"roots{n - 1}", f"up{n}", f"twice{n}")
    return roots


def _named(scratch: Scratch, prints: DataFrame, width: int) -> DataFrame:
    """fp, members, component_id (the smallest doc_id) and root (a fingerprint) of the component of each fingerprint."""
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members")), "distinct")
    roots = components(scratch, links(scratch, distinct, width))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first_id")
    rooted = scratch.save(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    found = scratch.save(with_key(rooted, ids, "root", "size", rooted.count()).select("fp", "component_id", "root"), "found")
    named = distinct.join(found, "fp", "left")
    named = scratch.save(named.select("fp", "members", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root")), "named")
    scratch.drop("distinct", "rooted", "found")
    return named


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs), "prints")
    named = _named(scratch, prints, width)
    return with_key(prints, named, "fp", "members", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """docs, all columns, and the fingerprint of the text."""
    at = docs.columns.index("text")
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # by place, as names with dots cannot be sent to Arrow

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                fps = pa.array([_signed(fingerprint(t)) for t in part.column(at).cast(pa.binary()).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, fps], names=[*part.schema.names, "fp"])

    schema = T.StructType([*placed.schema.fields, T.StructField("fp", T.LongType())])
    return placed.transform(bounded).mapInArrow(run, schema).toDF(*docs.columns, name)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without the near copies, all columns: of each component one row stays.

    It is the row with the smallest doc_id; of several rows of that doc_id in a component (or, where no row has a doc_id,
    of all its rows) the one with the least text. Rows that share a doc_id but nothing else are told apart.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs), "prints")
    named = _named(scratch, prints, WIDTH)
    found = scratch.save(with_key(prints, named, "fp", "members", prints.count()).select("doc_id", "component_id"), "components")
    per_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = scratch.save(per_id.where("n = 1 AND doc_id IS NOT NULL AND NOT stays").select("doc_id"), "gone")
    mixed = scratch.save(per_id.where("n > 1 OR doc_id IS NULL").select("doc_id"), "ids")
    if mixed.isEmpty():
        return without(docs, gone)
    several, rest = parted(docs, mixed)
    fp, uid = (fresh(docs, c) for c in ("__fp", "__uid"))
    several = scratch.save(_with_fingerprint(several, fp).withColumn(uid, F.monotonically_increasing_id()), "several")
    keys = several.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(fp).alias("fp"), F.col(uid).alias("uid"))
    least = F.min(F.struct(F.col("text").isNull().alias("none"), "text", "uid"))
    first = keys.groupBy("fp", "doc_id").agg(least.alias("row"))  # so that no group of copies is joined
    first = first.join(named, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = first.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.uid").alias(uid))
    return without(rest, gone).unionByName(several.join(chosen, uid, "left_semi").select(columns(docs)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
