import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.llm import variants
from tidewater.llm.common import Scratch

from ..conftest import SF
from .helpers import odd_documents, table

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def plain(docs):
    """word: (form, root, n, n_near, form_n), by deleting each character of each word."""
    counts = Counter()
    for i, text in docs:
        for w in RUNS.findall((text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= own - {w}
    form = {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(variants.op11_variants(spark, SF)) == plain(docs)


def chains():
    """Words that lead to others over several steps, ties, repeated letters, and odd rows."""
    rng = random.Random(2)
    base = ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ÀÿÀÿÀÿÀ", "unchanged", "stepstones", "stepstoness", "stepstonesss"]
    times = {"stepstones": 4000, "stepstoness": 300, "stepstonesss": 20, "stepstonessss": 2, "unchanged": 50, "unchangee": 3, "unchangef": 3, "tiedwords": 40, "tiedwordt": 40, "tiedwordx": 4}
    for w in base:
        for _ in range(30):
            k = rng.randrange(len(w))
            times.setdefault(rng.choice([w[:k] + w[k + 1 :], w[:k] + "ab"[rng.randrange(2)] + w[k:], w[:k] + "z" + w[k + 1 :]]), rng.randrange(1, 60))
    return [(1000 + i, " ".join([w] * n)) for i, (w, n) in enumerate(times.items())] + [(i, t) for i, t, *_ in odd_documents()]


@pytest.mark.parametrize("q", [2, 3, 5])
def test_every_gram_length_gives_the_same(spark, q):
    docs = chains()
    frame = table(spark, [(i, t, "en", "x") for i, t in docs]).withColumns({"word": F.lit("clash"), "near": F.lit(1)})
    want = plain(docs)
    assert found(variants.variants(frame, q)) == want
    assert max(len([w for w in want if want[w][1] == r]) for r in {v[1] for v in want.values()}) > 2  # some form stands for several


def test_long_lists_are_cut_into_tiles(spark):
    """Words that differ in one place share all but some of their grams."""
    docs = [(i, f"{a}bcdefgh{b} " * 2) for i, (a, b) in enumerate((chr(97 + x), chr(97 + y)) for x in range(26) for y in range(26))]
    vocabulary = variants.words(table(spark, [(i, t, "en", "x") for i, t in docs]))
    pairs = [{tuple(r) for r in variants.near_pairs(Scratch(spark), vocabulary, tile=t).collect()} for t in (16, 4096)]
    known = list(plain(docs))
    want = {(w, x) for w in known for x in known if len(w) == len(x) and sum(a != b for a, b in zip(w, x)) == 1}
    assert pairs[0] == pairs[1] and {p[:2] for p in pairs[0]} >= want


def test_empty_table(spark):
    assert variants.variants(table(spark, [])).count() == 0
