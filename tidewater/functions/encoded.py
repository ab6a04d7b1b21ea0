"""JSON cells: encoding, decoding with a fallback, maps with integer keys, largest entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(cell: Column, schema: str, fallback: Column | None = None) -> Column:
    """The cell's value; blank, null and malformed cells give the fallback."""
    text = F.when(F.length(F.trim(cell)) > 0, cell)
    value = F.from_json(text, schema)
    return value if fallback is None else F.coalesce(value, fallback)


def int_float_map(cell: Column) -> Column:
    """A map of JSON strings as integers to doubles, without the entries that are neither."""
    raw = F.coalesce(decode(cell, "map<string,string>"), F.create_map().cast("map<string,string>"))
    good = F.map_filter(raw, lambda k, v: k.try_cast("int").isNotNull() & v.try_cast("double").isNotNull())
    return F.transform_values(F.transform_keys(good, lambda k, _: k.cast("int")), lambda _, v: v.cast("double"))


def largest(m: Column, n: int = 5) -> Column:
    """The n entries of the greatest values, as an array of (key, value); ties by key."""
    by_value = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key"))))
    return F.transform(F.slice(by_value, 1, n), lambda e: F.struct(e["key"].alias("key"), (-e["neg"]).alias("value")))
