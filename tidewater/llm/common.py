"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are turned into Python objects at once; bounds memory when texts are long.
SLICE = 128
#: The bytes of [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of this machine's, but only for a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_folder(spark)}/tidewater-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch of texts; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches hold BATCH_BYTES at most, or what the session sets where that is less.

    Each task has such batches in its JVM and its Python worker, so Spark's own bound of 64 MB fills an executor of
    many cores. Results do not depend on it.
    """
    spark = df.sparkSession
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if now > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; where its files give fewer partitions than there are cores, dealt out over these.

    Files are cut into parts of 4 MB where that is needed to give each core one, so what is dealt out is a table of under
    4 MB a core.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def rows(batch: pa.RecordBatch, binary: str | None = None, step: int = SLICE) -> Iterator[tuple]:
    """The batch's rows as tuples, a slice at a time. binary: a string column to give as UTF-8 bytes."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        columns = [c.cast(pa.binary()) if n == binary else c for n, c in zip(part.schema.names, part.columns)]
        yield from zip(*(c.to_pylist() for c in columns))


def code_points(utf8: bytes) -> int:
    return len(utf8.translate(None, _CONTINUATION))


def table(schema: pa.Schema, data: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*data)) if data else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def columns(df: DataFrame) -> list:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def null_safe(a: DataFrame, b: DataFrame, names: list[str]):
    """Join condition under which nulls are equal."""
    out = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        out = out & a[n].eqNullSafe(b[n])
    return out


def word_count(text="text"):
    """Number of [^\\x20\\x09-\\x0D]+ in a text (null: 0), without Python."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: 64-bit words of a screen: 8 MiB of bits, whatever the input.
SCREEN_WORDS = 1 << 20


def _bits(h):
    """Four bits of a word for a hash."""
    out = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(h, 20 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def screened(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that may have one of the ids (doc_id, nulls too), and the rest, which surely have none.

    A Bloom filter of fixed size (one word and four bits in it for each id) is built by a grouped bit_or and broadcast
    as at most SCREEN_WORDS rows; so the texts of the rest need no shuffle. A filter that too many ids fill only lets
    more through.
    """
    h = F.xxhash64(F.col("doc_id").cast("long"))
    slot = h.bitwiseAND(F.lit(SCREEN_WORDS - 1))
    of, want, word, bits = (fresh(docs, c) for c in ("__of", "__want", "__word", "__bits"))
    words = F.broadcast(ids.select(slot.alias(word), _bits(h).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits)))
    own = docs.withColumns({of: slot, want: _bits(h)})
    marked = own.join(words, own[of] == words[word], "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(F.col(want)) == F.col(want), F.lit(False))
    return marked.where(hit).select(columns(docs)), marked.where(~hit).select(columns(docs))


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents whose doc_id is one of the ids (nulls too), and the rest; only texts of possible ones are shuffled.

    Documents without a doc_id are in one part or the other all together, by one flag, so they meet nowhere. Rows of one
    doc_id are the large side of a semi join, which Spark cuts where they are many.
    """
    unnamed, named = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    maybe, rest = screened(named, ids.where("doc_id IS NOT NULL"))
    same = maybe["doc_id"] == ids["doc_id"]
    flag = fresh(docs, "__null")
    any_null = F.broadcast(ids.agg(F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False)).alias(flag)))  # one row
    flagged = unnamed.join(any_null, F.lit(True))
    inside, outside = (flagged.where(F.col(flag) == x).select(columns(docs)) for x in (True, False))
    return maybe.join(ids, same, "left_semi").unionByName(inside), rest.unionByName(maybe.join(ids, same, "left_anti")).unionByName(outside)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is none of the ids."""
    return parted(docs, ids)[1]


#: A key of more rows than one in HOT_KEYS (and HOT_ROWS at least) is hot: there are at most HOT_KEYS of them.
HOT_KEYS, HOT_ROWS = 10_000, 1_000


def hot(per_key: DataFrame, members: str, total: int):
    """Condition for the hot keys of a table with a row and the number of members of each key, `total` in all."""
    return F.col(members) > max(HOT_ROWS, total // HOT_KEYS)


def with_key(rows_: DataFrame, per_key: DataFrame, key: str, members: str, total: int) -> DataFrame:
    """rows_ beside what the table has of their key; every row has a key there.

    The hot keys, fewer than HOT_KEYS rows, are broadcast; the others are joined by a shuffle in which none is large.
    """
    large = hot(per_key, members, total)
    split = F.broadcast(per_key.where(large))
    cold = rows_.join(split.select(key), key, "left_anti").join(per_key.where(~large), key)
    return rows_.join(split, key).unionByName(cold)
