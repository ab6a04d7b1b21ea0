"""The pipeline against the plain versions of its stages."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import common, mixing, pieces, quality

from ..conftest import SF
from .helpers import odd_documents, prose, table
from .test_dedup import plain_classes, plain_components, plain_fingerprint, plain_near_drop


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # quality rules
    want = {}
    for i, t in rows.items():
        verdict, cleaned = quality.judge(t.encode())
        if verdict["kept"]:
            want[i] = cleaned.decode()
    # exact dedup
    kept = {k[0] for k in plain_classes([(i, t) for i, t in want.items()]) if k[3]}
    want = {i: t for i, t in want.items() if i in kept}
    # near-dedup
    near = plain_components([(i, plain_fingerprint(t)) for i, t in want.items()])
    want = {i: want[i] for i, _, c in near if i == c}
    got, seen = docs, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        got = stage(spark, got, SF)
        assert got.columns == docs.columns
        path = f"{corpus_pipeline.common.Scratch(spark).base}/stage{n}"
        got.write.parquet(path)
        got = spark.read.parquet(path)
        seen.append(got.count())
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    # mix: as the operator's own figures say
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(got).collect() if r["size"]}
    model = pieces.pieces(pieces.model_path()).library
    expected = Counter()
    for i, t in want.items():
        ids = model.encode(t)
        expected[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += copies.get(i, 0)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in rows) == +expected
    assert re.fullmatch("[0-9a-f]{64}", rows[0]["decoded_sha256"])


def run_on(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def test_odd_rows(spark, tmp_path):
    """Nulls in each column, empty and very long texts, repeated rows and ids, ties, clashing columns: against plain stages."""
    good = [(i, "\n".join(prose(i * 10 + k, 30) + "." for k in range(3)), "en", "x") for i in range(12)]
    rows = odd_documents() + good + good[:3] + [(None, good[4][1], "en", None), (None, good[4][1] + " ", None, "y"), (3, prose(77, 90) + ".", "en", "x"), (3, prose(78, 90) + ".", None, None)]
    rows += [(50, prose(79, 40_000) + ".", "en", "z"), (51, prose(79, 40_000) + ".", "en", "z")]
    docs = table(spark, rows).withColumns({"kept": F.lit("clash"), "fp": F.lit("clash"), "size": F.lit("clash"), "__uid": F.lit("clash"), "a.b": F.lit("clash")})
    got = Counter((r["doc_id"], r["n_tokens"]) for r in run_on(spark, tmp_path, docs).collect())
    kept = []
    for i, t, la, s in rows:
        verdict, cleaned = quality.judge((t or "").encode())
        if verdict["kept"]:
            kept.append((i, cleaned.decode(), la, s))
    best = {}  # exact copies: the longest, then the smallest id, none last
    for at, (i, t, *_) in enumerate(kept):
        body, key = re.sub(r"[\x20\x09-\x0D]", "", t), (-len(t), i is None, i or 0)
        if body not in best or key < best[body][0]:
            best[body] = key, at
    kept = [kept[at] for _, at in sorted(best.values(), key=lambda x: x[1])]
    near = plain_near_drop(kept)
    kept = [r for r in kept if near[(r[0], r[1])]]
    assert len(kept) > 10 and {None, 3} & {r[0] for r in kept}
    # all sources share one target rule: what is mixed are copies of what was kept
    model = pieces.pieces(pieces.model_path()).library
    tokens = {(i, len(model.encode(t))) for i, t, *_ in kept}
    assert set(got) <= tokens and max(got.values()) <= 3
    mixed = mixing.mix(table(spark, kept)).collect()
    assert sum(got.values()) == sum(r["taken"] // r["size"] for r in mixed if r["size"])


def test_empty_tables(spark, tmp_path):
    assert run_on(spark, tmp_path, table(spark, [])).count() == 0
    bare = tmp_path / "bare"
    bare.mkdir()
    assert run_on(spark, bare, table(spark, [(1, None, None, None), (None, "", "en", "x"), (2, "short", "en", "x")])).count() == 0


def test_batches_are_bounded(spark):
    """A larger bound of the session is lowered, a smaller one stays; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = common.documents(spark, SF)
    found = []
    try:
        for given, want in (("64m", str(common.BATCH_BYTES)), ("1k", "1k")):
            spark.conf.set(key, given)
            encoded = corpus_pipeline.encode(spark, corpus_pipeline.quality_rules(spark, docs, SF), SF)
            found.append(sorted(encoded.collect()))
            assert spark.conf.get(key).removesuffix("b") == want
    finally:
        spark.conf.unset(key)
    assert found[0] and found[0] == found[1]
