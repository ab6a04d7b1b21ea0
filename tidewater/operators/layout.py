"""Layouts: which slice of the key space lies on which server, and how layouts change.

A layout is a table of slices (slice_id, lo, hi, size, server), the key range half open. Layouts are never changed in
place: each operator gives a new one, so undoing means keeping the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EPS
from ..sources.shared import written
from .intervals import missed, point_join
from .ordered import numbered

COLUMNS = ("slice_id", "lo", "hi", "size", "server")


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("slice_id", F.row_number().over(Window.orderBy(*order)).cast("long"))


def multi_shard(keys: DataFrame, parts: Column, weight, n_servers: int) -> DataFrame:
    """parts shards of unequal size for each key (k, size), all on server k % n_servers.

    weight(k, part): positive; sizes are in its proportion and the last part takes the rounding.
    """
    cut = keys.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    w = weight(F.col("k"), F.col("part"))
    own = Window.partitionBy("k")
    share = cut.withColumn("w", w).withColumn("share", F.col("size") * F.col("w") / F.sum("w").over(own))
    before = F.coalesce(F.sum("share").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = share.withColumn("size", F.when(F.col("part") == F.col("parts") - 1, F.col("size") - before).otherwise(F.col("share")))
    return _numbered(share, "k", "part").select("slice_id", F.col("k").alias("lo"), (F.col("k") + 1).alias("hi"), "size", (F.col("k") % n_servers).alias("server"))


def chunked(keys: DataFrame, chunk: int, n_servers: int) -> DataFrame:
    """Ranges of chunk keys, dealt to servers in turn."""
    n = F.floor(F.col("k") / chunk).cast("int")
    out = keys.groupBy(n.alias("n")).agg(F.min("k").alias("lo"), (F.max("k") + 1).alias("hi"), F.sum("size").alias("size"))
    return out.select((F.col("n") + 1).cast("long").alias("slice_id"), "lo", "hi", "size", (F.col("n") % n_servers).alias("server"))


def cut(cuts: DataFrame, end: DataFrame) -> DataFrame:
    """slice_id, lo, hi of the ranges that begin at 0 and at each cut, up to `end` (one row)."""
    starts = cuts.select(F.col("cut").cast("long").alias("lo")).unionByName(cuts.sparkSession.range(1).select(F.col("id").alias("lo"))).distinct()
    own = written(numbered(starts, ["lo"], "slice_id"))
    after = own.select((F.col("slice_id") - 1).alias("slice_id"), F.col("lo").alias("hi"))
    return own.join(after, "slice_id", "left").join(F.broadcast(end), F.lit(True)).select("slice_id", "lo", F.coalesce("hi", "end").cast("long").alias("hi"))


def open_ended(cuts: DataFrame, end: int) -> DataFrame:
    """The cuts (version, lo, ...) with hi: the version's next cut, or the end. A version's cuts are few."""
    return cuts.withColumn("hi", F.coalesce(F.lead("lo").over(Window.partitionBy("version").orderBy("lo")), F.lit(end)))


def from_cuts(keys: DataFrame, cuts: DataFrame, n_servers: int) -> DataFrame:
    """Ranges that begin at key 0 and at each cut, dealt to servers in turn."""
    ranges = cut(cuts, keys.agg((F.max("k") + 1).alias("end")))
    out = point_join(keys.select("k", "size"), ranges, "k").groupBy("slice_id", "lo", "hi").agg(F.sum("size").alias("size"))
    return out.select("slice_id", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "size", ((F.col("slice_id") - 1) % n_servers).cast("int").alias("server"))


def keymap(slices: DataFrame) -> DataFrame:
    """A row for each key and each slice that covers it, in the order of the largest slice: k, slice_id, server, size, span, nth."""
    per_key = slices.withColumn("k", F.explode(F.sequence("lo", F.col("hi") - 1))).withColumn("span", F.greatest(F.lit(1), F.col("hi") - F.col("lo")))
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.col("size").desc(), "slice_id"))
    return per_key.withColumn("nth", nth).select("k", "slice_id", "server", "size", "span", "nth")


def primaries(slices: DataFrame) -> DataFrame:
    """k, server: where each key's largest slice lies. Taken once, from the first layout."""
    return keymap(slices).where("nth = 1").select("k", "server")


def uncovered(keys: DataFrame, slices: DataFrame) -> DataFrame:
    return missed(keys, slices, "k")


def over_capacity(slices: DataFrame, servers: DataFrame) -> DataFrame:
    held = slices.groupBy("server").agg(F.sum("size").alias("held"))
    return servers.join(held, "server").where("held > capacity").select("server", "held", "capacity")


def check(keys: DataFrame, slices: DataFrame, servers: DataFrame) -> None:
    """Raises where a key has no slice or a server holds more than it can."""
    for name, bad in (("keys without a slice", uncovered(keys, slices)), ("servers over capacity", over_capacity(slices, servers))):
        if found := bad.limit(5).collect():
            raise ValueError(f"{name}: {[tuple(r) for r in found]}")


def snapshot(slices: DataFrame) -> DataFrame:
    """Per cluster (key): slice ids, servers and shard sizes, ordered as in the keymap."""
    entry = F.struct("nth", "slice_id", "server", "size")
    rows = keymap(slices).groupBy("k").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    return rows.select(F.col("k").alias("cluster"), F.col("s.slice_id").alias("slices"), F.col("s.server").alias("servers"), F.col("s.size").alias("shard_sizes"))


def state(slices: DataFrame, loads: DataFrame | None = None, by: tuple = ()) -> DataFrame:
    """One row per `by`: slices (structs by id), key_to_slice, key_to_server, cluster_to_slices, cluster_to_servers, cluster_shard_sizes.

    A slice's cluster is its key if it has one only. loads: by..., slice_id, load; what is missing is 0. Lists go by key.
    """
    if loads is not None:
        slices = slices.drop("load").join(loads.select(*by, "slice_id", "load"), [*by, "slice_id"], "left").na.fill(0.0, ["load"])
    elif "load" not in slices.columns:
        slices = slices.withColumn("load", F.lit(0.0))
    cluster = F.when(F.col("hi") - F.col("lo") == 1, F.col("lo")).alias("cluster")
    rows = slices.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slice_id", "lo", "hi", cluster, "size", "load", "server"))).alias("slices"))
    keyed = slices.withColumn("k", F.explode(F.sequence("lo", F.col("hi") - 1)))
    per_key = keyed.groupBy(*by, "k").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "slice_id", "server", "size"))).alias("o"))
    per_key = per_key.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "o"))).alias("c"))
    each = lambda name: F.transform("c", lambda e: e["o"][name])
    lists = per_key.select(*by, F.transform("c", lambda e: e["o"][0]["slice_id"]).alias("key_to_slice"), F.transform("c", lambda e: e["o"][0]["server"]).alias("key_to_server"), each("slice_id").alias("cluster_to_slices"), each("server").alias("cluster_to_servers"), each("size").alias("cluster_shard_sizes"))
    return rows.join(lists, list(by)) if by else rows.join(F.broadcast(lists), F.lit(True))


class Versions:
    """A layout and those before it; each is a frame of its own, so undoing a step is taking the frame before."""

    def __init__(self, slices: DataFrame):
        self.frames = [slices]

    @property
    def now(self) -> DataFrame:
        return self.frames[-1]

    def apply(self, step, *given, **named) -> DataFrame:
        """step: a function of the slices, such as split, merge or reassign."""
        self.frames.append(step(self.now, *given, **named))
        return self.now

    def undo(self) -> DataFrame:
        if len(self.frames) == 1:
            raise ValueError("there is no step to undo")
        self.frames.pop()
        return self.now


def reassign(slices: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: slice_id, to."""
    out = slices.join(moves, "slice_id", "left")
    return out.withColumn("server", F.coalesce("to", "server")).select(*COLUMNS, *[c for c in slices.columns if c not in COLUMNS])


def split(slices: DataFrame, chosen: DataFrame, part_ratio: Column) -> DataFrame:
    """Two slices for each chosen one (slice_id): ranges at their middle in halves, single keys by part_ratio.

    Ids go on from the largest. Slices of one key and no size stay whole.
    """
    top = slices.agg(F.max("slice_id").alias("top"))
    hit = slices.join(chosen.select("slice_id").distinct(), "slice_id", "left_semi")
    single = F.col("hi") - F.col("lo") <= 1
    hit = hit.where(~(single & (F.col("size") <= EPS)))
    loaded = "load" in slices.columns
    hit = hit.withColumn("r", F.when(single, part_ratio).otherwise(F.lit(0.5))).withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
    hit = hit.join(F.broadcast(top), F.lit(True)).withColumn("first", F.col("top") + 2 * F.row_number().over(Window.orderBy("slice_id")) - 1)

    def half(n: int) -> Column:
        lo = F.when(single | F.lit(n == 0), F.col("lo")).otherwise(F.col("mid"))
        hi = F.when(single | F.lit(n == 1), F.col("hi")).otherwise(F.col("mid"))
        size = F.col("size") * F.col("r") if n == 0 else F.col("size") - F.col("size") * F.col("r")
        load = [(F.col("load") * F.col("r") if n == 0 else F.col("load") - F.col("load") * F.col("r")).alias("load")] if loaded else []
        return F.struct((F.col("first") + n).cast("long").alias("slice_id"), lo.alias("lo"), hi.alias("hi"), size.alias("size"), "server", *load)

    new = hit.select(F.explode(F.array(half(0), half(1))).alias("s")).select("s.*")
    columns = [*COLUMNS, "load"] if loaded else list(COLUMNS)
    return slices.join(hit.select("slice_id"), "slice_id", "left_anti").select(*columns).unionByName(new.select(*columns))


def hottest_slices(slices: DataFrame, hot_keys: DataFrame) -> DataFrame:
    """For each hot key the slice of the greatest load, then size, then smallest id; once each."""
    per_key = slices.withColumn("k", F.explode(F.sequence("lo", F.col("hi") - 1))).join(hot_keys.select("k").distinct(), "k", "left_semi")
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.col("load").desc(), F.col("size").desc(), "slice_id"))
    return per_key.withColumn("nth", nth).where("nth = 1").select("slice_id").distinct()


def mergeable(slices: DataFrame) -> DataFrame:
    """server, a, b: neighbours on a server, by range, that touch or have the same range."""
    order = Window.partitionBy("server").orderBy("lo", "hi", "slice_id")
    nxt = F.lead(F.struct("slice_id", "lo", "hi")).over(order)
    pairs = slices.withColumn("n", nxt).where((F.col("n.lo") == F.col("hi")) | ((F.col("n.lo") == F.col("lo")) & (F.col("n.hi") == F.col("hi"))))
    return pairs.select("server", F.col("slice_id").alias("a"), F.col("n.slice_id").alias("b"))


def merge(slices: DataFrame, pairs: DataFrame) -> DataFrame:
    """One slice for each pair (a, b) of distinct slices; it has the id that follows the largest."""
    top = slices.agg(F.max("slice_id").alias("top"))
    named = pairs.withColumn("n", F.row_number().over(Window.orderBy("a")))
    member = named.select("n", F.explode(F.array("a", "b")).alias("slice_id"))
    sums = [F.sum(c).alias(c) for c in ("size", "load") if c in slices.columns]
    both = slices.join(member, "slice_id").groupBy("n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("server").alias("server"), *sums)
    both = both.join(F.broadcast(top), F.lit(True)).withColumn("slice_id", F.col("top") + F.col("n"))
    return slices.join(member, "slice_id", "left_anti").select(*slices.columns).unionByName(both.select(*slices.columns))


def grow_on(slices: DataFrame, servers: DataFrame, frac: float, add: float) -> DataFrame:
    """slice_id, server, size_before, size_after, delta of the slices that grow on the given servers."""
    on = slices.join(servers.select("server").distinct(), "server", "left_semi")
    on = on.withColumn("delta", F.col("size") * frac + F.lit(add)).where("delta > 0")
    return on.select("slice_id", "server", F.col("size").alias("size_before"), (F.col("size") + F.col("delta")).alias("size_after"), "delta")


def one_per_key(keys: DataFrame, placed: DataFrame) -> DataFrame:
    """A slice for each key with id k + 1; placed: k, server."""
    return keys.join(placed, "k").select((F.col("k") + 1).cast("long").alias("slice_id"), F.col("k").alias("lo"), (F.col("k") + 1).alias("hi"), "size", "server")


def per_server(slices: DataFrame, servers: DataFrame) -> DataFrame:
    """server, keyspace, slice_count of every server."""
    held = slices.groupBy("server").agg(F.sum("size").alias("keyspace"), F.count(F.lit(1)).alias("slice_count"))
    return servers.select("server").join(held, "server", "left").select("server", F.coalesce("keyspace", F.lit(0.0)).alias("keyspace"), F.coalesce("slice_count", F.lit(0)).alias("slice_count"))
