"""Reports of ticks: what was measured, as a long table, and as text for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import shown

#: Units of measures; others have none.
UNITS = {"latency": "work", "workload": "work", "mean_work": "work", "work": "work", "hottest_work": "work", "coldest_work": "work", "load": "work", "util": "of capacity", "keyspace": "size", "growth_added_total": "size", "heat": "heat", "fanout": "servers", "hot_probe_ratio": "of probes"}
_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def measured(series: DataFrame, of: str | None = None) -> DataFrame:
    """t, measure, of, value, unit: a row for each number column of a series.

    of: the column that says whose measure it is (a server, a cluster); without it measures are of the run.
    """
    names = [c for c, kind in series.dtypes if kind in _NUMBERS and c not in ("t", of)]
    whose = F.lit("run") if of is None else F.concat(F.lit(of + " "), F.col(of).cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"), F.lit(UNITS.get(c, "")).alias("unit")) for c in names])
    long = series.select("t", whose.alias("of"), F.explode(cells).alias("m"))
    return long.select("t", "m.measure", "of", "m.value", "m.unit").where("value IS NOT NULL")


def report(parts: list[DataFrame]) -> DataFrame:
    """t, text: the measures of a tick in the order of their names, a line each; whole numbers are shown as such."""
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    number = F.when((F.col("value") == F.floor("value")) & (F.abs("value") < 1e15), F.col("value").cast("long").cast("string")).otherwise(shown(F.col("value")))
    line = F.concat(F.lit("- "), "measure", F.lit(" ("), "of", F.lit(") = "), number, F.when(F.col("unit") != "", F.concat(F.lit(" "), "unit")).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("measure", "of", line.alias("line")))), lambda e: e["line"])
    return long.groupBy("t").agg(lines.alias("lines")).select("t", F.concat_ws("\n", F.format_string("## tick %d", "t"), "lines").alias("text"))


def write_report(texts: DataFrame, path: str) -> None:
    texts.coalesce(1).sortWithinPartitions("t").select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)
