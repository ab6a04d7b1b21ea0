"""Operator 11: spelling variants by a positional q-gram inverted index with count filtering.

Words are padded and cut into q-grams with their positions. One edit changes at most q of a word's grams; the others
stand in both words, at the same place or, behind an inserted character, one place later, and in the same order. So the
first unchanged gram of two words one edit apart, in one order of all grams, is among the first q + 1 of either: only
these are posted, the rarest first. A posting list belongs to a gram, its position and the length of the shorter word
(length limit); a word stands in the lists of its own length at its gram's position, and in those of the length below
at that position and the one before (position limit). A list's entries come merged by length. Each pair of a list is
tallied over all grams, pairs under the one-edit overlap bound go, and the others are verified.

The order of grams comes from 2**BUCKETS counters over all words, whatever their number; any order gives the same
pairs. A list of over TILE entries is cut into blocks that meet two at a time, so that no task holds more.

Null and empty texts have no words. A null doc_id counts as an empty string in the hash of its runs. Repeated rows count
as often as they stand there. Equal frequencies go by code points. Other columns are ignored. Empty tables give empty
results. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, documents

RUN, LEAST, TIMES, SLIP = "[A-Za-zÀ-ÿ]+", 7, 2, 31
#: A form is so many times as frequent.
RATIO = 10
#: Characters of a gram; at most 7, as grams are integers of a byte a character.
Q = 5
BUCKETS, TILE = 20, 4096
#: Pairs tallied at once.
PAIRS = 1 << 18
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """word, n of all texts, with a character of some runs deleted by a hash of document and run."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", _CAPITALS, _SMALL), F.lit(RUN), F.lit(0)))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("run")).where(F.length("run") >= LEAST)
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(h % SLIP == 0, slipped).otherwise(F.col("run"))
    out = found.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= TIMES)


# ---- grams


def _by_length(strings: list[str]):
    """Places and a matrix of bytes of the words of each length; all characters are below U+0100."""
    lengths = np.array([len(s) for s in strings])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, np.frombuffer("".join([strings[i] for i in at]).encode("latin-1"), np.uint8).reshape(len(at), length)


def grams(letters: np.ndarray, q: int) -> np.ndarray:
    """A row of len + q - 1 gram codes for each row of bytes; padding is byte 0."""
    padded = np.pad(letters, ((0, 0), (q - 1, q - 1))).astype(np.int64)
    n = letters.shape[1] + q - 1
    out = np.zeros((len(letters), n), np.int64)
    for k in range(q):
        out = out << 8 | padded[:, k : k + n]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (_mixed(codes) >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _strings(batch: pa.RecordBatch, name: str = "word") -> list[str]:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def frequencies(vocabulary: DataFrame, q: int = Q) -> np.ndarray:
    """Words' grams in each of 2**BUCKETS buckets; a task sends one count for each."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches):
        counts = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            for _, letters in _by_length(_strings(batch)):
                counts += np.bincount(_bucket(grams(letters, q)).ravel(), minlength=1 << BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], schema=schema)

    out = np.zeros(1 << BUCKETS, np.int64)
    for bucket, n in vocabulary.select("word").transform(bounded).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        out[bucket] = n
    return out


_POSTING = "key long, longer boolean, word string, n long"


def postings(spark: SparkSession, vocabulary: DataFrame, order: np.ndarray, q: int = Q) -> DataFrame:
    """key, longer, word, n: entries of the lists; longer: the word is one longer than the list's length."""
    schema = pa.schema([("key", pa.int64()), ("longer", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
    shared = spark.sparkContext.broadcast(order)  # 2**BUCKETS numbers, whatever the words

    def run(batches):
        for batch in batches:
            strings, n = _strings(batch), batch.column(batch.schema.names.index("n"))
            if not strings:
                continue
            keys, longer, whose = [], [], []
            for at, letters in _by_length(strings):
                codes, length = grams(letters, q), letters.shape[1]
                rank = shared.value[_bucket(codes)]
                # by frequency, then gram, then position
                first = np.lexsort((np.broadcast_to(np.arange(codes.shape[1]), codes.shape), codes, rank), axis=1)[:, : q + 1]
                code = np.take_along_axis(codes, first, 1)
                for shift, below in ((0, 0), (0, 1), (1, 1)):
                    key = _mixed(_mixed(code).view(np.int64) ^ (first - shift << 32 | length - below))
                    keys.append(key.view(np.int64).ravel())
                    longer.append(np.full(key.size, bool(below)))
                    whose.append(np.repeat(at, key.shape[1]))
            whose = pa.array(np.concatenate(whose))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(longer)), batch.column(batch.schema.names.index("word")).take(whose), n.take(whose)], schema=schema)

    return vocabulary.select("word", "n").transform(bounded).mapInArrow(run, _POSTING)


# ---- pairs


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _edited(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, ga: np.ndarray, gb: np.ndarray, q: int) -> np.ndarray:
    """Which pairs of rows x of a, y of b are one edit apart; b has the length of a or one more. ga, gb: their grams.

    The tally of shared grams at the same place (and one later, where b is longer) has to reach the overlap bound; what
    does is verified by its letters.
    """
    if a.shape[1] == b.shape[1]:
        kept = np.flatnonzero((ga[x] == gb[y]).sum(axis=1) >= ga.shape[1] - q)
        return kept[(a[x[kept]] != b[y[kept]]).sum(axis=1) == 1]
    left, right = ga[x], gb[y]
    kept = np.flatnonzero(((left == right[:, :-1]) | (left == right[:, 1:])).sum(axis=1) >= ga.shape[1] - q + 1)
    left, right = a[x[kept]], b[y[kept]]
    before = np.logical_and.accumulate(left == right[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate(left[:, ::-1] == right[:, :0:-1], axis=1).sum(axis=1)
    return kept[before + behind >= a.shape[1]]


def _list_pairs(lists: np.ndarray, longer: np.ndarray):
    """Chunks of pairs of places, of entries sorted by list and longer: each shorter entry with all behind it in its list."""
    new = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    ends = np.repeat(np.r_[new[1:], len(lists)], np.diff(np.r_[new, len(lists)]))
    first = np.flatnonzero(~longer)
    n = ends[first] - first - 1
    first, n = first[n > 0], n[n > 0]
    upto = np.cumsum(n)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        i = np.repeat(first[at:to], n[at:to])
        yield i, i + 1 + _within(n[at:to])
        at = to


def pairs_of(lists: np.ndarray, longer: np.ndarray, strings: list[str], q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that are one edit apart, found in the lists; a pair may be found in several."""
    length, row, letters, codes = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64), {}, {}
    for at, own in _by_length(strings):
        size = own.shape[1]
        length[at], row[at], letters[size], codes[size] = size, np.arange(len(at)), own, grams(own, q)
    found = []
    for i, j in _list_pairs(lists, longer):
        kind = length[i] * 2 + (length[j] - length[i])
        kind = np.where((length[j] - length[i] == longer[j]), kind, -1)  # else two lists share a key
        for k in np.unique(kind[kind >= 0]):
            here = np.flatnonzero(kind == k)
            a, b = int(k) // 2, int(k) // 2 + int(k) % 2
            hit = here[_edited(letters[a], letters[b], row[i[here]], row[j[here]], codes[a], codes[b], q)]
            found.append((i[hit], j[hit]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


_PAIRS = "word string, near string, near_n long"


def _met(q: int):
    """Both directions of the near pairs of lists; rows come sorted by list and longer."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def met(part: pa.Table):
        lists = np.cumsum(np.r_[0, _changes(part)])
        words_, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
        i, j = pairs_of(lists, part.column("longer").to_numpy(), words_.to_pylist(), q)
        i, j = pa.array(np.r_[i, j]), pa.array(np.r_[j, i])
        return pa.RecordBatch.from_arrays([words_.take(i), words_.take(j), n.take(j)], schema=schema)

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            if rest is not None:
                part = pa.concat_tables([rest, part])
            cuts = np.flatnonzero(_changes(part))
            last = int(cuts[-1]) + 1 if len(cuts) else 0  # the last list may go on
            if last:
                yield met(part.slice(0, last))
            rest = part.slice(last)
        if rest is not None:
            yield met(rest)

    return run


def _changes(part: pa.Table) -> np.ndarray:
    key, tile = part.column("key").to_numpy(), part.column("tile").to_numpy()
    return (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])


def near_pairs(scratch: Scratch, vocabulary: DataFrame, q: int = Q, tile: int = TILE) -> DataFrame:
    """word, near, near_n: each two words of the vocabulary (word, n) that are one edit apart, both ways."""
    spark = vocabulary.sparkSession
    posted = postings(spark, vocabulary, frequencies(vocabulary, q), q)
    posted = scratch.save(posted, "postings")
    large = posted.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("blocks"))
    large = scratch.save(large, "large")
    split = posted.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own).cast("long") * F.col("blocks") + F.greatest(o, own))
    split = split.select("key", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(tiles)).alias("tile"), "longer", "word", "n")
    dealt = split.repartition("key", "tile").sortWithinPartitions("key", "tile", "longer")
    return dealt.transform(bounded).mapInArrow(_met(q), _PAIRS).distinct()


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form): the last of the forms that follow each other.

    A form is RATIO times as frequent as its word, so no chain of them is longer than the digits of a count; each round
    doubles the steps.
    """
    now, n = forms.select("word", F.col("form").alias("root")), 0
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = scratch.save(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{n}")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now, n = now.select("word", "root"), n + 1


def variants(docs: DataFrame, q: int = Q) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.save(words(docs.select("doc_id", "text")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")))
    found = near_pairs(scratch, vocabulary, q).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = vocabulary.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= RATIO * F.col("n"), F.col("best")).alias("best"))
    found = scratch.save(found.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")), "found")
    rooted = roots(scratch, found.where("form IS NOT NULL").select("word", "form"))
    return found.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir).select("doc_id", "text"))
