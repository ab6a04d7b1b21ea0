"""Operator 3: mixing sources to target weights by Pareto order sampling.

Sizes are words. The sources' shares of all words follow WEIGHTS by code point order (null last); a target stops at
MAX_COPIES times its source's size and the excess is reshared by weight (a water level, found from sorted ratios).
Within a source a document is expected e times: the same factor for all, tilted by TILT for each doubling of its size,
at most MAX_COPIES. floor(e) copies are certain. For one more, documents are ranked by random odds u/(1-u), divided by
the odds of the fraction p = e - floor(e) (Pareto order sampling); they are taken in rank order until the source's
words are reached. The ranks are cut by a histogram over 65,536 key ranges, so only the range in which the words run
out is ordered row by row, with TOP_UP further documents. The first that does not fit ends the plain rank order; of
those after it the ones that still fit are taken, unless the sample is to be strict: then it is the first documents in
rank order whose words come nearest.

u comes from a hash of doc_id and text: reruns agree, and rows that share a doc_id (or have none) are spread over the
ranges. Ties go by doc_id, then size. Null and empty texts have size 0 and are not taken. A null source is a source.
Rows of a source that repeat both doc_id and text have one draw: all of them are taken or none, so however many there are,
they are one row where rows are ordered. Texts of any length are counted whole. Other columns are ignored by mix() and
kept by mix_documents(). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, word_count

WEIGHTS, MAX_COPIES, TILT, RANGES, BLOCK, TOP_UP = (1, 2, 3), 3, 0.05, 65_536, 256, 256


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    # one row per source from here on
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank - 1) % len(WEIGHTS) + 1).cast("double"))
    per = per.withColumn("cap", (MAX_COPIES * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - capped) / (F.sum("w").over(everything) - gone)
    per = per.withColumn("level", level)
    # the first source, by ratio, that the level does not reach: all before it are capped
    per = per.withColumn("nth", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
    open_ = F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))
    level = F.coalesce(F.min(open_).over(everything)["level"], F.lit(float("inf")))
    return per.select("source", "source_size", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def _expected(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies expected per size class of one source: min(MAX_COPIES, factor * tilt), whose words are the target."""
    pdf = pdf.sort_values("cls", ascending=False).reset_index(drop=True)
    tilt, words, target = 1 + TILT * pdf["cls"].to_numpy(float), pdf["words"].to_numpy(float), float(pdf["target"].iloc[0])
    e = np.full(len(pdf), float(MAX_COPIES))
    for k in range(len(pdf)):  # the k classes of the largest tilt are at the cap
        rest = (tilt[k:] * words[k:]).sum()
        if rest <= 0:
            continue
        factor = (target - MAX_COPIES * words[:k].sum()) / rest
        if factor * tilt[k] <= MAX_COPIES:
            e[k:] = np.maximum(0, factor * tilt[k:])
            break
    e = np.where(np.abs(e - np.rint(e)) < 1e-9, np.rint(e), e)
    return pd.DataFrame({"source": pdf["source"], "cls": pdf["cls"], "e": e})


def _sized(docs: DataFrame) -> DataFrame:
    """source, size and the hash that a row's draw comes from."""
    return docs.withColumns({"size": word_count("text"), "h": F.xxhash64("doc_id", "text", F.lit("mix"))})


def _keyed(df: DataFrame) -> DataFrame:
    """With whole copies, inclusion chance, ranking key and its range."""
    bits = F.col("h").bitwiseAND(F.lit((1 << 52) - 1))
    u = (bits + 0.5) / float(1 << 52)
    p = F.col("e") - F.floor("e")
    key = F.when((p > 0) & (F.col("size") > 0), u / (1 - u) * (1 - p) / p)
    df = df.withColumn("whole", F.floor("e").cast("long")).withColumn("key", key)
    return df.withColumn("range", F.floor(F.col("key") / (1 + F.col("key")) * RANGES).cast("int"))


def _class(size="size"):
    return F.when(F.col(size) > 0, F.length(F.bin(size))).otherwise(0)


def _with(df: DataFrame, plan: DataFrame, *on: str) -> DataFrame:
    """Null-safe left join that keeps df's columns and adds the plan's others."""
    renamed = plan.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in plan.columns])
    cond = df[on[0]].eqNullSafe(renamed[f"__{on[0]}"])
    for c in on[1:]:
        cond = cond & df[c].eqNullSafe(renamed[f"__{c}"])
    return df.join(renamed, cond, "left").drop(*[f"__{c}" for c in on])


def _fit(pdf: pd.DataFrame, strict: bool = False) -> pd.DataFrame:
    """Of one source's last candidates, in rank order, the draws that are taken; size is that of all rows of a draw."""
    pdf = pdf.sort_values(["key", "doc_id", "size"], kind="stable", na_position="last")
    sizes, left = pdf["size"].to_numpy(float), float(pdf["left"].iloc[0])
    if strict:
        picked = np.arange(len(pdf)) < np.abs(left - np.concatenate([[0], np.cumsum(sizes)])).argmin()
        return pdf.assign(picked=picked)[["source", "h", "picked"]]
    picked = np.zeros(len(pdf), bool)
    for k, size in enumerate(sizes):
        if size <= left:
            picked[k], left = True, left - size
    over = np.where(picked, np.inf, np.abs(sizes - left))
    if len(over) and over.min() < left:  # one more comes nearer than none
        picked[int(over.argmin())] = True
    return pdf.assign(picked=picked)[["source", "h", "picked"]]


def _crossing(scratch: Scratch, ranges: DataFrame, limits: DataFrame, column: str) -> DataFrame:
    """source, range, limit, words_before, n_upto: where a source's running sum of the column first exceeds its limit.

    Blocks of BLOCK ranges are summed first, then the one block of each source is searched, so that no window holds
    more than RANGES / BLOCK or BLOCK rows of a source.
    """
    upto = lambda c, by: F.sum(c).over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumn("block", F.floor(F.col("range") / BLOCK).cast("int"))
    blocks = ranges.groupBy("source", "block").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))
    sums = [upto(c, "block") for c in ("words", "n")]
    blocks = blocks.select("source", "block", *(s.alias(c) for s, c in zip(sums, ("words", "n"))), *((s - F.col(c)).alias(f"{c}_base") for s, c in zip(sums, ("words", "n"))))
    block = _with(blocks, limits, "source").where(F.col(column) > F.col("limit")).groupBy("source").agg(F.min(F.struct("block", "words_base", "n_base", "limit")).alias("at"))
    block = scratch.save(block.select("source", "at.*"), f"block_{column}")
    own = _with(ranges, block, "source", "block").where("limit IS NOT NULL")
    own = own.select("source", "range", "limit", "words", *((F.col(f"{c}_base") + upto(c, "range")).alias(f"{c}_upto") for c in ("words", "n")))
    at = F.min(F.struct("range", "limit", (F.col("words_upto") - F.col("words")).alias("words_before"), "n_upto")).alias("at")
    return own.where(F.col(f"{column}_upto") > F.col("limit")).groupBy("source").agg(at).select("source", "at.*")


class Mix:
    """The plan of a mix: expected copies by source and size class, and where each source's words run out."""

    def __init__(self, docs: DataFrame, strict: bool = False):
        self.scratch = scratch = Scratch(docs.sparkSession)
        narrow = _sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).select("doc_id", "source", "size", "h")
        self.rows = scratch.save(narrow.withColumn("cls", _class()), "sizes")
        self.targets = scratch.save(targets(self.rows), "targets")
        classes = _with(self.rows.groupBy("source", "cls").agg(F.sum("size").alias("words")), self.targets, "source")
        kind = docs.schema["source"].dataType.simpleString()
        self.expected = scratch.save(classes.groupBy("source").applyInPandas(_expected, f"source {kind}, cls int, e double"), "expected")
        keyed = _keyed(_with(self.rows, self.expected, "source", "cls"))
        certain = keyed.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
        budget = scratch.save(_with(self.targets, certain, "source").select("source", (F.col("target") - F.col("certain")).alias("budget")), "budget")
        ranges = scratch.save(keyed.where("key IS NOT NULL").groupBy("source", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "ranges")
        first = scratch.save(_crossing(scratch, ranges, budget.withColumnRenamed("budget", "limit"), "words"), "first")
        need = first.select("source", (F.col("n_upto") + TOP_UP - 1).cast("double").alias("limit"))
        last = _crossing(scratch, ranges, need, "n").select("source", F.col("range").alias("last"))
        cuts = _with(first.select("source", F.col("range").alias("first"), (F.col("limit") - F.col("words_before")).alias("left")), last, "source")
        self.cuts = scratch.save(cuts.withColumn("last", F.coalesce("last", F.lit(RANGES))), "cuts")
        self.ranked = _with(keyed, self.cuts, "source")
        self.inside = F.col("key").isNotNull() & F.col("first").isNotNull() & F.col("range").between(F.col("first"), F.col("last"))
        before = F.col("key").isNotNull() & (F.col("first").isNull() | (F.col("range") < F.col("first")))
        self.extra = F.coalesce(before, F.lit(False)).cast("long")
        window = self.ranked.where(self.inside).groupBy("source", "h", "key", "left").agg(F.min("doc_id").alias("doc_id"), F.sum("size").alias("size"))
        fit = window.groupBy("source").applyInPandas(lambda pdf: _fit(pdf, strict), f"source {kind}, h long, picked boolean")
        self.picked = scratch.save(fit.where("picked").select(F.col("source").alias("p_source"), F.col("h").alias("p_h")).distinct(), "picked")

    def taken(self, rows_: DataFrame) -> DataFrame:
        """rows_ of the plan (ranked) with `more`: 1 where a copy beyond the whole ones is taken."""
        inside = rows_.withColumn("__in", F.coalesce(self.inside, F.lit(False)))
        own = inside.join(self.picked, F.col("__in") & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("h") == F.col("p_h")), "left")
        return own.withColumn("more", F.when(F.col("__in"), F.col("p_h").isNotNull().cast("long")).otherwise(self.extra)).drop("__in", "p_source", "p_h")


def mix(docs: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    m = Mix(docs, strict)
    own = _with(m.taken(m.ranked).select("doc_id", "source", "size", "whole", "more"), m.targets, "source")
    return own.select("doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("more")) * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents, all columns, each as often as it is taken."""
    m = Mix(docs)
    own = _sized(docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))
    own = m.taken(_with(_keyed(_with(own.withColumn("cls", _class()), m.expected, "source", "cls")), m.cuts, "source"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0)
    return own.select("__row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("__nth")).select("__row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
