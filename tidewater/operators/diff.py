"""Differences between two layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import snapshot


def added_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind ('added' or 'removed') and the slice."""
    columns = ["slice_id", "lo", "hi", "size", "server"]
    new = after.join(before.select("slice_id"), "slice_id", "left_anti").select(F.lit("added").alias("kind"), *columns)
    gone = before.join(after.select("slice_id"), "slice_id", "left_anti").select(F.lit("removed").alias("kind"), *columns)
    return new.unionByName(gone)


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select("slice_id", F.col("server").alias("from")).join(after.select("slice_id", F.col("server").alias("to")), "slice_id")
    return both.where(F.col("from") != F.col("to"))


def key_migrations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose largest slice lies on another server: k, from, to."""
    first = lambda s, name: snapshot(s).select(F.col("cluster").alias("k"), F.get("servers", F.lit(0)).alias(name))
    return first(before, "from").join(first(after, "to"), "k").where(F.col("from") != F.col("to"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clusters of which the slices, servers or shard sizes changed, before and after."""
    fields = ("slices", "servers", "shard_sizes")
    old, new = (snapshot(s).select("cluster", *[F.col(f).alias(f"{f}_{n}") for f in fields]) for s, n in ((before, "before"), (after, "after")))
    changed = ~(F.col("slices_before").eqNullSafe(F.col("slices_after")) & F.col("servers_before").eqNullSafe(F.col("servers_after")) & F.col("shard_sizes_before").eqNullSafe(F.col("shard_sizes_after")))
    return old.join(new, "cluster", "full").where(changed)


def whole(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: slice_added, slice_removed, slice_moved, key_migrations, cluster_transitions as arrays of structs, in order."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))

    slices = added_removed(before, after)
    parts = [listed(slices.where(F.col("kind") == k).drop("kind"), f"slice_{k}") for k in ("added", "removed")]
    parts += [listed(moved(before, after), "slice_moved"), listed(key_migrations(before, after).withColumnRenamed("k", "key"), "key_migrations"), listed(transitions(before, after), "cluster_transitions")]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p), F.lit(True))
    return out


def counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, n of every kind of difference."""
    kinds = added_removed(before, after).select("kind")
    parts = [moved(before, after).select(F.lit("moved").alias("kind")), key_migrations(before, after).select(F.lit("key_migration").alias("kind")), transitions(before, after).select(F.lit("cluster_transition").alias("kind"))]
    for p in parts:
        kinds = kinds.unionByName(p)
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
