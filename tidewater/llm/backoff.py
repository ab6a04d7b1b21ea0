"""Back-off models of symbols as tables: built by Spark, written once, mapped by every worker.

A gram of k symbols is a number of k * bits bits, the last symbol in the lowest. A model has, for each order, the seen
grams with the logarithms of their probabilities, and the seen contexts with those of their back-off weights. Unseen grams take
the weight of their context, if it was seen, and what the shorter gram has. Several models of the same grams may stand
side by side: the logarithms are then rows of as many columns.
"""

from __future__ import annotations

import fcntl
import os

import numpy as np
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import Scratch

#: Logarithms in a file of the models.
PART = 1 << 20


def _pair(width: int) -> np.dtype:
    return np.dtype([("code", np.int64), ("log", np.float64)] + [("others", np.float32, (width - 1,))] * (width > 1))


class _Beside:
    """Logarithms of one model, and beside them those of others in single precision, read as rows of doubles."""

    def __init__(self, log: np.ndarray, others: np.ndarray):
        self.log, self.others, self.shape = log, others, (len(log), 1 + others.shape[1])

    def __getitem__(self, at) -> np.ndarray:
        if isinstance(at, tuple):
            rows_, k = at
            return self.log[rows_] if k == 0 else self.others[rows_, k - 1]
        out = np.empty((len(at), self.shape[1]))
        out[:, 0], out[:, 1:] = self.log[at], self.others[at]
        return out


def packed(code: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams at all `order` symbols that stand side by side in a string, of strings laid end to end; which string each is of."""
    out = np.zeros(max(0, len(code) - order + 1), np.int64)
    for k in range(order):
        out |= code[k : len(code) - order + 1 + k] << bits * (order - 1 - k)
    starts, n = np.cumsum(sizes) - sizes, np.maximum(sizes - order + 1, 0)
    return out[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(np.arange(len(sizes)), n)


class Backoff:
    """For each order sorted grams with log probabilities, and sorted contexts with log back-off weights."""

    def __init__(self, grams: list, backs: list, bits: int, floor: float | np.ndarray):
        self.grams, self.backs, self.bits, self.floor = grams, backs, bits, floor

    def log_p(self, codes: np.ndarray, order: int | None = None) -> np.ndarray:
        """Log probability of each gram's last symbol after those before it, by at most `order` symbols."""
        out, open_ = np.zeros((len(codes), *self.grams[0][1].shape[1:])), np.arange(len(codes))
        for k in range(order or len(self.grams), 0, -1):
            own = codes[open_] & ((1 << self.bits * k) - 1)
            hit, logs = self._find(self.grams[k - 1], own)
            out[open_[hit]] += logs
            open_, own = open_[~hit], own[~hit] >> self.bits
            hit, logs = self._find(self.backs[k - 1], own)
            out[open_[hit]] += logs
        out[open_] += self.floor
        return out

    def variant(self, k: int) -> Backoff:
        """One of the models that stand side by side."""
        own = lambda known: [(codes, logs[:, k]) for codes, logs in known]
        return Backoff(own(self.grams), own(self.backs), self.bits, self.floor[k])

    @staticmethod
    def _find(known: tuple, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, logs = known
        if not len(codes):
            return np.zeros(len(own), bool), np.empty((0, *logs.shape[1:]))
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        hit = codes[at] == own
        return hit, logs[at[hit]]


def publish(scratch: Scratch, rows_: DataFrame, logs: list[str] = ["log"], used: list[str] = []) -> tuple[list[str], dict[tuple[int, int], tuple[int, int]]]:
    """Names of files that every executor gets, with the rows (lang, kind, code, logs) in order; where each kind stands in all of them.

    The files are written by executors, PART logarithms each, to the shared folder; no row goes through the driver. lang is
    the number of a model. Kinds below the order are the grams of kind + 1 symbols, those from it on the contexts. The
    scratch tables `used` for the rows are dropped as soon as these are written.
    """
    spark = scratch.spark
    rows_ = scratch.save(rows_, "rows")
    scratch.drop(*used)
    spans, n = {}, 0
    for r in rows_.groupBy("lang", "kind").count().orderBy("lang", "kind").collect():
        spans[r["lang"], r["kind"]] = n, n + r["count"]
        n += r["count"]
    order = ("lang", "kind", "code")
    scratch.save(rows_.repartitionByRange(max(1, n * len(logs) // PART), *order).sortWithinPartitions(*order).select("code", *logs), "model")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch.base}/model")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    files = sorted((f.getPath().getName(), f.getPath().toString()) for f in found if f.getPath().getName().startswith("part-"))
    for _, path in files:
        spark.sparkContext.addFile(path)
    scratch.drop("rows")
    return [name for name, _ in files], spans


def mapped(files: list[str], spans: dict[tuple[int, int], tuple[int, int]], model: int, order: int, width: int = 1) -> tuple[list, list]:
    """Grams and contexts of a published model, by order, mapped into memory; width: logarithms of each."""
    own = np.asarray(np.memmap(_laid_out(files, width), _pair(width), "r")) if spans else np.empty(0, _pair(width))

    def part(k):
        of = own[slice(*spans.get((model, k), (0, 0)))]
        return of["code"], _Beside(of["log"], of["others"]) if width > 1 else of["log"]

    return [part(k) for k in range(order)], [part(order + k) for k in range(order)]


def _laid_out(files: list[str], width: int) -> str:
    """One file of pairs beside the executor's copies, written by the first of the machine's workers that needs it."""
    whole = SparkFiles.get(files[0]) + ".pairs"
    with open(whole + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(whole):
            with open(whole + ".new", "wb") as out:
                for name in files:
                    for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(1 << 16):
                        pairs = np.empty(batch.num_rows, _pair(width))
                        code, *logs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                        pairs["code"], pairs["log"] = code, logs[0]
                        if width > 1:
                            pairs["others"] = np.stack(logs[1:], axis=1)
                        out.write(pairs.tobytes())
            os.replace(whole + ".new", whole)
    return whole
