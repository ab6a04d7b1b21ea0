import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import ranking

from .helpers import odd_documents, prose, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items, k=20):
    """(item, rank, doc, score) of every item, by whole scores."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        query, scores = Counter(plain_terms(text)), []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // words
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in query.items() if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_terms(text):
    assert [t.decode() for t in ranking.terms(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("block, items_at_once", [(1 << 15, 4096), (7, 2)])
def test_search_equals_plain(spark, monkeypatch, block, items_at_once):
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "ITEMS", items_at_once)
    monkeypatch.setattr(ranking, "STEP", 2)
    docs = [(i, t) for i, t, *_ in odd_documents()] + [(100 + i, prose(i % 40, 30 + i % 9)) for i in range(150)] + [(500 + i, "alpha1 tie") for i in range(60)]
    items = [(1, prose(3, 12)), (2, "alpha1 tie tie"), (3, None), (4, ""), (5, "nowhere at all"), (None, "ABC abc é中 z"), (6, docs[9][1][:400]), (1, prose(4, 20))]
    frame = table(spark, [(i, t, "en", "x") for i, t in docs]).withColumns({"item_id": F.lit(0), "terms": F.lit("clash"), "n": F.lit(1)})
    got = ranking.search(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(docs, items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(table(spark, []), items).count() == 0
    assert ranking.search(table(spark, [(1, "a", "en", "x")]), items.limit(0)).count() == 0


def test_stops_early_and_completes():
    """A rare term decides; the postings of the common one are not all taken, and scores are whole all the same."""
    rng = np.random.default_rng(1)
    n = 50_000
    doc = np.r_[np.arange(n), np.arange(30)]
    term = np.r_[np.zeros(n, np.int64), np.ones(30, np.int64)]
    impact = np.r_[rng.integers(1, 1000, n), rng.integers(10**6, 2 * 10**6, 30)]
    block = ranking.Block(term, doc, impact, 2, n)
    total = defaultdict(int)
    for d, i in zip(doc.tolist(), impact.tolist()):
        total[d] += i
    first = sorted(total, key=lambda d: (-total[d], d))[:20]
    taken, add = [], np.add.at

    class Counted:
        at = staticmethod(lambda score, docs, gains: (taken.append(len(docs)), add(score, docs, gains)))

    ranking.np.add, kept = Counted, ranking.np.add
    try:
        docs, scores = block.best([(0, 1), (1, 1)], 20, 1)
    finally:
        ranking.np.add = kept
    assert docs.tolist() == first and scores.tolist() == [total[d] for d in first]
    assert sum(taken) < n / 2
