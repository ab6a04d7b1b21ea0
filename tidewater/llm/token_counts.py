"""Operator 5: token counts kept by signed deltas.

A ledger lives in a folder of the shared store. Each batch of changes (insert, delete, revise) becomes signed entries,
(doc_id, source, lang, tokenizer, tokens, sign), dealt into buckets by a hash of doc_id, and a rollup of them by source,
language and tokenizer version. A folder has as many buckets as its entries fill, a power of two. A batch counts once
its commit stands, which is written last: a numbered file that names the batch, its folder and the number of its buckets,
and that only one writer can bring into place. A base's commit also names the batches before it, so no writer reads
further back than the last base. So a batch that was lost midway is written
anew, one that was committed is not applied again, and a writer that was overtaken starts again from the new state.
Totals add the committed rollups, never the documents. After KEEP batches they are compacted into one base of net
entries; earlier folders stay until tidy().

delete takes away all that the ledger holds of a doc_id before the batch; revise does, and inserts the new text. Deletes
and revises read the buckets that their doc_ids fall in, of each folder. Of several revise rows of one doc_id in a batch one stands (the
greatest hash of text, source and lang); insert rows all count, repeated ones as often as they stand. Rows with another
or no op, and delete and revise rows without a doc_id, do nothing. Null texts have 0 tokens; null sources and languages
are groups of their own. Other columns are ignored. An empty batch commits an empty delta.

Tokens are counted by the sentencepiece library, texts of any length whole: those over LONG characters in parts that
begin at a run of spaces, which no piece reaches over.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, documents
from .pieces import SPACE, model_path, pieces

#: Version names change with the tokenizer: counts of different ones never add up.
WORDS, PIECES = "words-1", "piece-bpe-32k-1"
KEYS = ("source", "lang", "tokenizer")
#: Entries of a bucket, about, and buckets of a folder at most; batches between two compactions; characters encoded in one piece or one call.
ROWS, BUCKETS, KEEP, LONG = 100_000, 4096, 16, 1 << 18

_CUT = re.compile(r"(?<! ) (?=[\s\S])")


def parts_of(text: str, long: int = LONG) -> Iterator[str]:
    """Texts whose numbers of pieces add up to that of the text. Each but the first begins a run of spaces, less one space."""
    if len(text) > long:
        text, at = text.replace(SPACE, " "), 0
        while found := _CUT.search(text, at + long):
            yield text[at : found.start()]
            at = found.end()  # the space that the library puts before a text stands for this one
        text = text[at:]
    yield text


def piece_counts(texts: list[str], encode, long: int = LONG) -> list[int]:
    """Number of pieces of each text; the library gets about `long` characters at once."""
    n, part, of, size = [0] * len(texts), [], [], 0
    for k, text in enumerate(texts):
        for own in parts_of(text, long):
            part.append(own)
            of.append(k)
            size += len(own)
            if size > long:
                for i, ids in zip(of, encode(part)):
                    n[i] += len(ids)
                part, of, size = [], [], 0
    for i, ids in zip(of, encode(part)):
        n[i] += len(ids)
    return n


def _counted(batches):
    schema = pa.schema([("op", pa.string()), ("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("h", pa.int64()), ("words", pa.int64()), ("pieces", pa.int64())])
    encode = pieces(model_path()).library.encode
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = [t or "" for t in part.column("text").to_pylist()]
            words = pa.array([len(t.encode().split()) for t in texts], pa.int64())
            counts = pa.array(piece_counts(texts, encode), pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(f.name).cast(f.type) for f in list(schema)[:5]), words, counts], schema=schema)


def _tokenised(changes: DataFrame) -> DataFrame:
    """op, doc_id, source, lang, h (a hash of text, source and lang), words, pieces."""
    own = [F.col("op").cast("string").alias("op"), F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang"))]
    given = changes.select(*own, F.xxhash64("text", "source", "lang").alias("h"), F.col("text").cast("string").alias("text"))
    return given.transform(bounded).mapInArrow(_counted, "op string, doc_id long, source string, lang string, h long, words long, pieces long")


def _by_tokenizer(counted: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.lit(WORDS).alias("tokenizer"), F.col("words").alias("tokens")), F.struct(F.lit(PIECES).alias("tokenizer"), F.col("pieces").alias("tokens"))))
    return counted.select("doc_id", "source", "lang", both.alias("t")).select("doc_id", "source", "lang", "t.tokenizer", "t.tokens")


def count_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: a row per document and tokenizer version."""
    return _by_tokenizer(_tokenised(docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", "text")))


def _bucket(buckets: int):
    """Rows without a doc_id are never looked up: they are dealt by what they hold."""
    return F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("source", "lang", "tokens")).otherwise(F.xxhash64("doc_id")), F.lit(buckets)).cast("int")


def _bucket_of_id(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _buckets(rows_: int) -> int:
    return min(BUCKETS, 1 << max(0, (rows_ // ROWS).bit_length()))


_ENTRY = "doc_id long, source string, lang string, tokenizer string, tokens long, sign int, bucket int"
_ROLLUP = "source string, lang string, tokenizer string, docs long, tokens long"


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self._conf), path

    # ---- the log of commits

    def _commits(self) -> list[tuple[int, object]]:
        fs, path = self._path("commits")
        return sorted((int(s.getPath().getName()), s.getPath()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _entry(self, path) -> dict:
        return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(path.getFileSystem(self._conf).open(path), "UTF-8"))

    def log(self) -> list[dict]:
        """All commits in order: batch (None for a compacted base), folder, buckets; a base's batches."""
        return [self._entry(path) for _, path in self._commits()]

    def _state(self) -> tuple[int, list[dict], set[str]]:
        """The next commit's number, the commits from the last base on, and all batches that count."""
        found, commits = self._commits(), []
        for _, path in reversed(found):
            commits.append(self._entry(path))
            if commits[-1]["batch"] is None:
                break
        done = {c["batch"] for c in commits if c["batch"] is not None} | {b for c in commits for b in c.get("batches", ())}
        return (found[-1][0] + 1 if found else 0), commits[::-1], done

    def committed(self) -> list[str]:
        """Batches that count, in order."""
        return [c["batch"] for c in self.log() if c["batch"] is not None]

    def _commit(self, number: int, entry: dict) -> bool:
        """Bring the commit of this number into place; False if another writer did so before."""
        fs, attempt = self._path(f"attempts/{uuid.uuid4().hex}")
        out = fs.create(attempt, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, place = self._path(f"commits/{number:09d}")
        fs.mkdirs(place.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(attempt, place, options)  # fails where the number is taken
        except (Py4JJavaError, PySparkException):
            if not fs.exists(place):
                raise
            fs.delete(attempt, False)
            return False
        return True

    # ---- tables

    def _read(self, commits: list[dict], kind: str, schema: str, where=None) -> DataFrame:
        """All rows of the commits' folders; where: a condition that depends on a folder's number of buckets."""
        frames = []
        for c in commits:
            own = self.spark.read.schema(schema).parquet(f"{self.folder}/{c['folder']}/{kind}")
            frames.append(own if where is None else own.where(where(c["buckets"])))
        return functools.reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def _write(self, entries: DataFrame, folder: str, rows_: int) -> int:
        """Entries by bucket, and their rollup; the number of buckets for about so many rows."""
        place, buckets = f"{self.folder}/{folder}", _buckets(rows_)
        dealt = entries.withColumn("bucket", _bucket(buckets))
        dealt.repartition("bucket", F.xxhash64("doc_id", *KEYS, "tokens") % 4).write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/entries")
        delta = self.spark.read.schema(_ENTRY).parquet(f"{place}/entries").groupBy(*KEYS)
        delta = delta.agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{place}/rollup")
        return buckets

    def _net(self, entries: DataFrame) -> DataFrame:
        net = entries.groupBy("doc_id", *KEYS, "tokens").agg(F.sum("sign").alias("n")).where("n <> 0")
        return net.select("doc_id", *KEYS, "tokens", F.col("n").cast("int").alias("sign"))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: op, doc_id, source, lang, text. False if the batch was committed before."""
        size = 2 * changes.count()  # a row for each of two tokenizers, about
        while True:
            number, commits, done = self._state()
            if batch_id in done:
                return False
            folder = f"batches/{uuid.uuid4().hex}"
            buckets = self._write(self._entries(commits, changes, Scratch(self.spark)), folder, size)
            if self._commit(number, {"batch": batch_id, "folder": folder, "buckets": buckets, "rows": size}):
                if len(commits) >= KEEP:
                    self.compact()
                return True

    def _entries(self, commits: list[dict], changes: DataFrame, scratch: Scratch) -> DataFrame:
        """Signed entries of a batch."""
        counted = _tokenised(changes.where("op = 'insert' OR op = 'revise' AND doc_id IS NOT NULL"))
        ids = changes.where("op IN ('delete', 'revise') AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
        ids = scratch.save(ids.distinct(), "ids")
        if ids.isEmpty():
            return _by_tokenizer(counted).withColumn("sign", F.lit(1))
        counted = scratch.save(counted, "counted")
        one = F.max_by(F.struct("source", "lang", "words", "pieces"), "h").alias("row")
        revised = counted.where("op = 'revise'").groupBy("doc_id").agg(one).select("doc_id", "row.*")
        rows_ = counted.where("op = 'insert'").select(*revised.columns).unionByName(revised)
        added = _by_tokenizer(rows_).withColumn("sign", F.lit(1))
        most = max((c["buckets"] for c in commits), default=1)
        wanted = [r["b"] for r in ids.select(_bucket_of_id(most).alias("b")).distinct().collect()]  # BUCKETS numbers at most
        # numbers of buckets are powers of two, so a bucket of one folder lies in one of each with fewer
        before = self._read(commits, "entries", _ENTRY, lambda n: F.col("bucket").isin(sorted({b % n for b in wanted})))
        held = self._net(before.join(ids, "doc_id", "left_semi"))
        return added.unionByName(held.withColumn("sign", -F.col("sign")))

    def compact(self) -> bool:
        """One base of net entries in place of all batches so far; False if another writer committed meanwhile."""
        number, commits, done = self._state()
        folder = f"batches/{uuid.uuid4().hex}"
        size = sum(c["rows"] for c in commits)
        buckets = self._write(self._net(self._read(commits, "entries", _ENTRY)), folder, size)
        return self._commit(number, {"batch": None, "folder": folder, "buckets": buckets, "rows": size, "batches": sorted(done)})

    def tidy(self) -> None:
        """Delete folders that no longer count. Not while others read or write."""
        fs, path = self._path("batches")
        keep = {c["folder"].rsplit("/", 1)[-1] for c in self._state()[1]}
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName() not in keep:
                fs.delete(s.getPath(), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over the committed batches."""
        rollups = self._read(self._state()[1], "rollup", _ROLLUP)
        return rollups.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in two batches, of which the first is sent twice; a tenth is deleted and inserted again, another revised."""
    docs = documents(spark, sf_dir)
    ledger = Ledger(spark, Scratch(spark).base)
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    of = lambda op, rows: rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", "text")
    ledger.apply("load-1", of("insert", docs.where(even)))
    ledger.apply("load-2", of("insert", docs.where(~even)))
    ledger.apply("load-1", of("insert", docs.where(even)))
    tenth = docs.where("doc_id % 10 = 0")
    ledger.apply("withdraw", of("delete", tenth))
    ledger.apply("restore", of("insert", tenth))
    ledger.apply("revise", of("revise", docs.where("doc_id % 10 = 5")))
    return ledger.totals()
