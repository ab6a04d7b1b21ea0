"""Operator 13: ranked lexical search over impact-ordered postings, score at a time.

A posting's impact is its exact integer share of a score: weight of the term times the saturated frequency of the term
in the document. Postings of a block of documents are grouped by term and exact impact, greatest first. A query takes
whole impact groups of all its terms from the greatest impact downwards into accumulators; what a document can still
gain is at most the sum of the terms' next impacts. It stops only when that bound proves that no document outside the
candidates reaches the k-th score; then the candidates' scores are completed from the terms that are left.

One pass over the texts gives the figures of the collection and the postings of the queries' terms (written to the
shared folder, term numbers and frequencies by document, so a term in every document is in no list of one task). The
second pass works on blocks of at most BLOCK documents where they lie; the k-th score that a task has reached so far
serves its later blocks as a bound. A task gives k rows for each query, ranked by one window.

Queries are taken ITEMS and TERMS at a time, whatever their number: what the driver and a closure hold is bounded by
that; each such block of queries passes over all documents.

A null or empty text has no terms, so it is in no result and not counted in N. A null or empty query has no result.
Repeated rows are documents (or queries) of their own. Equal scores go by ascending doc_id, null first, and equal
doc_ids are told apart by nothing but their place, so their rows are alike. Other columns are ignored. Empty tables
give empty results.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, documents, rows

K, BLOCK = 20, 1 << 15
#: Queries, and their distinct (query, term) pairs, of one pass; a query of more terms is a pass of its own.
ITEMS, TERMS = 4096, 1 << 18
#: Postings that a query takes between two looks at the bound, at least.
STEP = 4096

#: Bytes of terms, A-Z lower-cased; the others separate. UTF-8 bytes of characters beyond ASCII are 80 to FF.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


_POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"


def _counted(vocabulary: dict[bytes, int]):
    """A row for each document with any term: its length, and the queries' terms in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches):
        find = vocabulary.get
        for batch in batches:
            out = ([], [], [], [])
            for doc_id, text in rows(batch, "text"):
                own = terms(text)
                if own:
                    held = [(t, tf) for word, tf in Counter(own).items() if (t := find(word)) is not None]
                    for column, value in zip(out, (doc_id, len(own), [t for t, _ in held], [tf for _, tf in held])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


class Block:
    """Postings of some documents: for each term, documents and impacts, greatest impact first."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.by_doc = np.lexsort((doc, term))  # for completing scores
        self.doc_sorted, self.impact_by_doc = doc[self.by_doc], impact[self.by_doc]

    def _of(self, t: int, docs: np.ndarray) -> np.ndarray:
        """Impacts of a term in some documents."""
        a, b = self.starts[t], self.starts[t + 1]
        own = self.doc_sorted[a:b]
        at = np.minimum(np.searchsorted(own, docs), max(0, len(own) - 1))
        return np.where(own[at] == docs, self.impact_by_doc[a:b][at], 0) if len(own) else np.zeros(len(docs), np.int64)

    def best(self, query: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k first by (score, document), of those that reach `least`, scores above 0.

        query: (term, its repeats). Documents are numbered in the order of ties.
        """
        lists = []  # repeats, impacts, documents
        for t, repeats in query:
            a, b = self.starts[t], self.starts[t + 1]
            if b > a and self.impact[a] > 0:
                end = a + int(np.searchsorted(-self.impact[a:b], 0))  # impact 0 adds nothing
                lists.append((repeats, self.impact[a:end], self.doc[a:end], t))
        if not lists:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        score, at = np.zeros(self.n_docs, np.int64), [0] * len(lists)
        bound = sum(r * int(i[0]) for r, i, _, _ in lists)
        step, floor_, candidates = STEP, max(1, least), None
        while bound:
            # whole impact groups of all lists, down to a level that takes about `step` postings
            heads = sorted((r * int(i[min(len(i) - 1, p + max(1, step // len(lists)))]) for (r, i, _, _), p in zip(lists, at) if p < len(i)), reverse=True)
            top = max(r * int(i[p]) for (r, i, _, _), p in zip(lists, at) if p < len(i))
            level = min(top, heads[0])
            taken_docs, taken = [], []
            for j, (r, i, d, _) in enumerate(lists):
                to = at[j] + int(np.searchsorted(-i[at[j] :], -level // r, side="right")) if at[j] < len(i) else at[j]
                if to > at[j]:
                    taken_docs.append(d[at[j] : to])
                    taken.append(i[at[j] : to] * r)
                    at[j] = to
            docs, gains = np.concatenate(taken_docs), np.concatenate(taken)
            np.add.at(score, docs, gains)
            step *= 2
            bound = sum(r * int(i[p]) for (r, i, _, _), p in zip(lists, at) if p < len(i))
            reached = score[score > 0]
            if len(reached) >= k:
                floor_ = max(floor_, int(np.partition(reached, len(reached) - k)[len(reached) - k]))
            if bound < floor_:  # a document that has nothing yet cannot reach the k-th
                candidates = np.flatnonzero(score + bound >= floor_)
                if len(candidates) <= max(4 * k, len(docs) // 8) or not bound:
                    break
        if candidates is None:
            candidates = np.flatnonzero(score)
        if bound:
            exact = np.zeros(len(candidates), np.int64)
            for r, _, _, t in lists:
                exact += r * self._of(t, candidates)
        else:
            exact = score[candidates]
        keep = exact >= floor_
        candidates, exact = candidates[keep], exact[keep]
        first = np.lexsort((candidates, -exact))[:k]
        return candidates[first], exact[first]


_FOUND = "item int, doc_id long, score long"


def _impacts(term, tf, m, weights):
    return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _ranked(queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_words: int, k: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]  # (-score, is not null, doc_id)
        for ids, n, counts, term, tf in _blocks(batches):
            order = np.argsort([i if i is not None else -(1 << 63) for i in ids], kind="stable")  # documents in the order of ties
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            m = np.array([75 + 25 * x * n_docs // n_words for x in n], np.int64)
            owner = np.repeat(np.arange(len(ids)), counts)
            block = Block(term, place[owner], _impacts(term, tf, m[owner], weights), len(weights), len(ids))
            for q, query in enumerate(queries):
                least = -best[q][-1][0] if len(best[q]) == k else 1
                docs, scores = block.best(query, k, least)
                if len(docs):
                    named = [(-int(s), (i := ids[order[d]]) is not None, i or 0) for d, s in zip(docs.tolist(), scores.tolist())]
                    best[q] = sorted(best[q] + named)[:k]
        out = [(q, i if known else None, -s) for q, own in enumerate(best) for s, known, i in own]
        columns = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _blocks(batches):
    """ids, lengths, numbers of postings, terms and frequencies of at most about BLOCK documents."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= BLOCK:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(held):
    whole = pa.Table.from_batches(held).combine_chunks()
    ids, n = whole.column(0).to_pylist(), whole.column(1).to_pylist()
    lists, tfs = (whole.column(c).chunk(0) for c in (2, 3))
    return ids, n, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()


def _passes(items: DataFrame):
    """Blocks of queries: lists of (item_id, terms with repeats)."""
    own, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        found = Counter(terms(row["text"].encode() if row["text"] is not None else None))
        if not found:
            continue
        if own and (len(own) >= ITEMS or size + len(found) > TERMS):
            yield own
            own, size = [], 0
        own.append((row["item_id"], found))
        size += len(found)
    if own:
        yield own


RESULT = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k first documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    scratch, out = Scratch(spark), None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for nth, own in enumerate(_passes(items)):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, found in own for t in found))}
        postings = scratch.save(texts.transform(bounded).mapInArrow(_counted(vocabulary), _POSTINGS), f"postings{nth}")
        figures = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
        if not figures["docs"]:
            continue
        dfs = postings.select(F.explode("terms").alias("t")).groupBy("t").count()
        weights = np.full(len(vocabulary), weight(figures["docs"], 0), np.int64)
        for row in dfs.toLocalIterator():  # a row for each of the block's terms at most
            weights[row["t"]] = weight(figures["docs"], row["count"])
        queries = [[(vocabulary[t], r) for t, r in found.items()] for _, found in own]
        found = postings.transform(bounded).mapInArrow(_ranked(queries, weights, figures["docs"], figures["words"], k), _FOUND)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(own)], "item int, item_id long")
        named = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: ITEMS rows at most
        out = named if out is None else out.unionByName(named)
    return spark.createDataFrame([], RESULT) if out is None else out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(documents(spark, sf_dir).select("doc_id", "text"), items)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _unnested(id_: str, table: str) -> str:
    return f"SELECT {id_}, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '{_TERM}')) AS term FROM {table}"


SQL = f"""
WITH d AS ({_unnested("doc_id", "documents")}),
q AS (SELECT item_id, term, count(*) AS repeats FROM ({_unnested("item_id", "benchmark")}) GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM len),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
m AS (SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM len, c),
s AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
