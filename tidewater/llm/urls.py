"""Operator 6: URL filters by rules and a character language-model ratio.

Rules decide where they fit. Every other url is judged by two variable-order Markov models of its bytes (A-Z lower-cased),
one of the urls that rules accept and one of those they reject, smoothed by Witten-Bell interpolation: a byte's probability
after up to ORDER - 1 bytes mixes what followed the longest context seen LEAST times and more with that of the next shorter
one. All labelled urls but a fifth, by hash, are counted, and the models grow with them: they are worked out as tables,
written to files in the shared folder by executors and mapped by the workers. On the fifth left out, the order (2 to ORDER) of the best
balanced accuracy is chosen, the smallest of equal ones, and the threshold: of the mean log-likelihood difference per
byte, the middle of the range of that best accuracy, over a histogram of all of them. A url at the threshold is allowed.

Null and empty urls have empty host and path, no rule and the verdict block. Unless both kinds of labelled url exist,
urls without a rule are allowed. Urls of any length are read whole, BLOCK bytes at once. Repeated rows are counted as often
as they stand and judged alike; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff import Backoff, mapped, packed, publish
from .common import Scratch, table

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
ORDER, BITS, LEAST, BINS, RANGE = 6, 8, 2, 800, 8.0
#: Bytes turned into grams at once; rows judged at once.
BLOCK, STEP = 1 << 20, 1024
LABELS = ("allow", "block")

_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def rule_for(host: str, path: str, rules: dict[str, str]) -> str | None:
    """The longest rule whose host is the url's or a parent of it, and whose path begins the url's."""
    fits = []
    for rule in rules:
        own, slash, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + tail):
            fits.append(rule)
    return max(fits, key=lambda r: (len(r), r), default=None)


def raw(url: str) -> bytes:
    """The url's bytes as the models see them, between edges (zero)."""
    return bytes(ORDER - 1) + url.translate(_LOWER).encode("utf-8", "replace").replace(b"\0", b"\1") + b"\0"


def grams(urls: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed grams at every byte and the closing edge of each url, and which url each is of."""
    strings, of, size = [], [], 0
    for k, url in enumerate(urls):
        whole = raw(url)
        for at in range(0, len(whole) - ORDER + 1, BLOCK):  # parts of a long url overlap by the context
            strings.append(whole[at : at + BLOCK + ORDER - 1])
            of.append(k)
            size += len(strings[-1])
            if size >= BLOCK:
                yield _grams(strings, of)
                strings, of, size = [], [], 0
    if strings:
        yield _grams(strings, of)


def _grams(strings: list[bytes], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
    codes, which = packed(np.frombuffer(b"".join(strings), np.uint8).astype(np.int64), np.array([len(x) for x in strings]), ORDER, BITS)
    return codes, np.array(of)[which]


def _held(url: str) -> bool:
    return xxhash.xxh64_intdigest(url.encode("utf-8", "replace"), 5) % 5 == 0


class UrlModel:
    """Published models, the order that is used of them, and the threshold."""

    def __init__(self, files: list[str], spans: dict):
        self.files, self.spans, self.order, self.threshold = files, spans, ORDER, 0.0

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    @property
    def models(self) -> list[Backoff]:
        if "_models" not in vars(self):
            self._models = [Backoff(*mapped(self.files, self.spans, i, ORDER), BITS, -BITS * np.log(2)) for i in range(2)]
        return self._models

    def scores(self, urls: list[str], orders: tuple[int, ...] = ()) -> np.ndarray:
        """Mean log-likelihood difference per byte by each order; above 0 is more like the accepted."""
        orders = orders or (self.order,)
        total, n = np.zeros((len(orders), len(urls))), np.zeros(len(urls))
        accepted, rejected = self.models
        for codes, of in grams(urls):
            unique, inverse = np.unique(codes, return_inverse=True)
            n += np.bincount(of, minlength=len(urls))
            for k, order in enumerate(orders):
                ratio = accepted.log_p(unique, order) - rejected.log_p(unique, order)
                total[k] += np.bincount(of, weights=ratio[inverse], minlength=len(urls))
        return total / np.maximum(n, 1)


def _labelled(batch: pa.RecordBatch, rules: dict[str, str], held: bool) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {label: [] for label in LABELS}
    for url in batch.column(0).to_pylist():
        if url and _held(url) == held and (rule := rule_for(*parts(url), rules)):
            found[rules[rule]].append(url)
    return found


def _counted(rules):
    schema = pa.schema([("lang", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for label, urls in enumerate(_labelled(batch, rules, False).values()):
                for codes, _ in grams(urls):
                    unique, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), label, np.int32)), pa.array(unique), pa.array(n)], schema=schema)

    return run


def tables(scratch: Scratch, counts: DataFrame) -> DataFrame:
    """Witten-Bell probabilities and weights of (lang, gram, n) as rows (lang, kind, code, log), as backoff.publish takes them."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].withColumn("gram", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)))
        levels[k] = scratch.save(shorter.groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"level{k}")
    out, lower = None, None
    for k in range(1, ORDER + 1):
        own = levels[k].withColumn("context", F.shiftright("gram", BITS))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts = scratch.save(contexts.where(F.col("total") >= LEAST) if k > 1 else contexts, f"contexts{k}")
        own = own.join(contexts, ["lang", "context"])
        if k == 1:
            own = own.withColumn("below", F.lit(1 / (1 << BITS)))
        else:  # a longer context that was seen often enough ends in a shorter one that was
            shorter = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(shorter, ["lang", "suffix"])
        p = (F.col("n") + F.col("kinds") * F.col("below")) / (F.col("total") + F.col("kinds"))
        lower = scratch.save(own.select("lang", "gram", p.alias("p")), f"p{k}")
        both = lower.select("lang", F.lit(k - 1).alias("kind"), F.col("gram").alias("code"), F.log("p").alias("log"))
        weights = contexts.select("lang", F.lit(ORDER + k - 1).alias("kind"), F.col("context").alias("code"), F.log(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("log"))
        both = both.unionByName(weights)
        out = both if out is None else out.unionByName(both)
    return out


def learn(pages: DataFrame, rules: dict[str, str] = RULES) -> UrlModel | None:
    """Count every labelled url but the fifth that is left out, then choose order and threshold on that."""
    urls, rules, scratch = pages.select("url"), dict(rules), Scratch(pages.sparkSession)
    counts = urls.mapInArrow(_counted(rules), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    if counts.select("lang").distinct().count() < 2:
        return None
    model = UrlModel(*publish(scratch, tables(scratch, counts)))
    scratch.drop("counts", *[f"{t}{k}" for k in range(1, ORDER + 1) for t in ("level", "contexts", "p")])
    sent = pages.sparkSession.sparkContext.broadcast(model)
    orders = tuple(range(2, ORDER + 1))

    def held(batches):
        schema = pa.schema([("label", pa.int32()), ("k", pa.int32()), ("bin", pa.int32())])
        for batch in batches:
            for label, own in enumerate(_labelled(batch, rules, True).values()):
                if own:
                    scores = sent.value.scores(own, orders)
                    at = np.clip((scores + RANGE) / (2 * RANGE) * BINS, 0, BINS - 1).astype(np.int32)
                    k = np.repeat(np.arange(len(orders), dtype=np.int32), len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, label, np.int32)), pa.array(k), pa.array(at.ravel())], schema=schema)

    bins = np.zeros((len(orders), 2, BINS))
    for r in urls.mapInArrow(held, "label int, k int, bin int").groupBy("k", "label", "bin").count().collect():
        bins[r["k"], r["label"], r["bin"]] += r["count"]
    if bins.sum(axis=2).all():
        model.order, model.threshold = best_cut(bins, orders)
    return model


def best_cut(bins: np.ndarray, orders: tuple[int, ...]) -> tuple[int, float]:
    """The order, and the threshold, of the best balanced accuracy of allowing from a bin on; bins by order and label."""
    found = []
    for order, (allow, block) in zip(orders, bins):
        # urls that are right if all from each bin on are allowed
        right = np.concatenate([[0], np.cumsum(block)]) / block.sum() + 1 - np.concatenate([[0], np.cumsum(allow)]) / allow.sum()
        good = np.flatnonzero(right >= right.max() - 1e-12)
        found.append((-round(float(right.max()), 12), order, float(good[len(good) // 2]) / BINS * 2 * RANGE - RANGE))
    return min(found)[1:]


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every page; without a model one is learned first."""
    rules = dict(rules)
    model = learn(pages, rules) if model is None else model
    sent = pages.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("ratio", pa.float64())])

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                ids, urls = (c.to_pylist() for c in batch.slice(at, STEP).columns)
                ratios = own.scores([u or "" for u in urls])[0].tolist() if own is not None else [None] * len(urls)
                out = []
                for page_id, url, ratio in zip(ids, urls, ratios):
                    host, path = parts(url)
                    rule = rule_for(host, path, rules)
                    liked = bool(url) and (ratio is None or ratio >= own.threshold)
                    out.append((page_id, host, path, rule, rules[rule] if rule else "allow" if liked else "block", ratio if url else None))
                yield table(schema, out)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, ratio double")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
