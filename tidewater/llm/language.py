"""Operator 10: language ID by interpolated Kneser-Ney character models.

Words are runs of letters (Unicode category L) of any length, lower-cased, between boundary marks. Counts of 5-grams are
taken over all training documents and all are kept; lower orders count the distinct characters before a gram. The orders
are worked out as tables and written by executors as sorted arrays of packed grams beside their probabilities and
back-off weights; each executor maps a copy, so no process holds the models and no row of them goes through the driver.
A gram is of ORDER symbols of 12 bits: a character below U+0800 is one, a letter beyond is spelled by two, so no two
texts are the same to a model. A text gets the language of the lowest cross-entropy per symbol; ties go to the smaller name.

Every labelled row is learned from, and every one fits the score, by models that have not seen it: the rows are in HELD
parts by a hash of doc_id, and beside each probability of all rows stand those without each part. The costs of each row,
whole and in windows of some words, under the models without its part give the temperature, which grows with a power of
the text's length: the score is the winner's posterior. `rejected` marks texts whose cross-entropy exceeds what 99.5 % of
the rows and windows of about their length reach. Rows of languages with under FEW rows are in no part: they are learned
from throughout and fit no score; nor do rows whose language has words in their own part only. Without any row that fits,
the temperature is 1 and none is rejected. Texts that are null or hold no letter are `und` with score 0, and so is all if
there is nothing to learn from; any letter gives a language. Texts of any length are read whole, BLOCK symbols at once.
The query does not learn from rows without a doc_id. Repeated rows are learned from as often as they stand; other columns
are ignored. There are as many models as values of lang.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .backoff import Backoff, mapped, packed, publish
from .common import Scratch, bounded, documents, rows, table

ORDER, BITS = 5, 12
#: Parts that rows of a language of FEW rows or more are left out by; words of the windows that texts are cut to for the score.
HELD, FEW, WINDOWS = 8, 32, (1, 2, 4, 8, 16, 32)
#: Lengths of texts are told apart by this many steps a doubling; steps of fewer texts than ALIKE have a bound of rejection together.
STEPS, ALIKE = 8, 2_000
#: What share of texts stays under the bound; cells of cross-entropy that it is looked for in.
REACHED, CELLS = 0.995, 256
#: Powers and temperatures that are tried.
TRIED = [(power, float(heat)) for power in (0.0, 0.25, 0.5, 0.75, 1.0) for heat in np.geomspace(0.05, 50, 40)]
WORD = regex.compile(r"\p{L}+")
#: Words counted, or whose costs are kept, by a worker at once; characters of a longer word, which is not kept.
CACHE, LONG = 300_000, 40
#: Numbers that the kept costs are, at most.
KEPT = 8_000_000
#: Characters turned into grams at once.
BLOCK = 1 << 22

_MASK = (1 << BITS) - 1
_EDGE = "\x01"


#: Of the bytes of Latin-1, letters stay and all others become spaces.
_LATIN = bytes(c if WORD.fullmatch(chr(c)) else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text)


#: Symbols of the second and the first half of a letter's number, from U+0800 on.
_LOW, _HIGH = 0x800, 0xC00


def _symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text, and how many each character has."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    wide = code >= _LOW
    n = 1 + wide
    if wide.any():
        second = np.zeros(n.sum(), bool)
        second[np.cumsum(n) - 1] = True
        code, wide = np.repeat(code, n), np.repeat(wide, n)
        code = np.where(wide, np.where(second, _LOW | code & 0x3FF, _HIGH | code >> 10), code)
    return code, n


def _packed(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams at all ORDER symbols that stand side by side in a string; which string each is of."""
    code, n = _symbols("".join(strings))
    sizes = np.array([len(x) for x in strings], np.int64)
    return packed(code, np.add.reduceat(n, np.cumsum(sizes) - sizes), ORDER, BITS)


def grams(words: list[str], block: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed grams at each symbol and the closing edge of each word, and which word each is of; about `block` symbols at once."""
    block, strings, of, size = block or BLOCK, [], [], 0
    for k, word in enumerate(words):
        whole = _EDGE * (ORDER - 1) + word + _EDGE
        strings.append(whole)
        of.append(k)
        size += len(whole)
        if len(whole) > block:  # alone, in parts that overlap by the context
            if len(strings) > 1:
                codes, which = _packed(strings[:-1])
                yield codes, np.array(of)[which]
            symbols, _ = _symbols(whole)
            for at in range(0, len(symbols) - ORDER + 1, block):
                part = symbols[at : at + block + ORDER - 1]
                codes, which = packed(part, np.array([len(part)]), ORDER, BITS)
                yield codes, which + k
            strings, of, size = [], [], 0
        elif size >= block:
            codes, which = _packed(strings)
            yield codes, np.array(of)[which]
            strings, of, size = [], [], 0
    if strings:
        codes, which = _packed(strings)
        yield codes, np.array(of)[which]


# ---- learning


#: Columns of counts: of all rows, and of all but each part. The models have as many.
VARIANTS = HELD + 1


def _counts(batches):
    """lang, gram, n and what of it each part has: what a task has counted, as often as its words fill CACHE."""
    names = ["n", *(f"own{p}" for p in range(HELD))]
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), *((name, pa.int64()) for name in names)])
    seen: dict[str, dict[int, Counter]] = {}
    size = held = 0

    def flush():
        for lang, parts in seen.items():
            words = list(dict.fromkeys(itertools.chain(*parts.values())))
            number = dict(zip(words, range(len(words))))
            weights = np.zeros((len(words), HELD + 2))
            for part, counter in parts.items():  # the last but one column is of rows in no part
                weights[[number[w] for w in counter], part] = list(counter.values())
            weights[:, -1] = weights.sum(axis=1)
            for codes, of in grams(words, max(1, BLOCK // 4)):
                unique, inverse = np.unique(codes, return_inverse=True)
                n = [np.bincount(inverse, weights=weights[of, p]).astype(np.int64) for p in (-1, *range(HELD))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(unique), pa.string()), pa.array(unique), *map(pa.array, n)], schema=schema)
        seen.clear()

    for batch in batches:
        for lang, part, text in rows(batch, step=64):
            words = words_of(text or "")
            counter = seen.setdefault(lang, {}).setdefault(part, Counter())
            size -= len(counter)
            counter.update(words)
            size += len(counter)
            if max(map(len, words), default=0) > LONG:
                held += sum(len(w) for w in words if len(w) > LONG)
            if size > CACHE or held > BLOCK:
                yield from flush()
                size = held = 0
    yield from flush()


class Model(Backoff):
    """One language, worked out from all of its grams at once; tables() does so where they are many."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, discount: float):
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(float)
        levels = {ORDER: (codes, counts)}
        for k in range(ORDER - 1, 0, -1):  # distinct characters before each shorter gram
            levels[k] = np.unique(levels[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
        size = len(levels[1][0]) + 1
        lower_codes, lower_p = np.empty(0, np.int64), np.empty(0)
        super().__init__([], [], BITS, -np.log(size))
        for k in range(1, ORDER + 1):
            own, n = levels[k][0], levels[k][1].astype(float)
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = discount if k == ORDER else once / (once + 2 * twice) if once and twice else 0.5
            d = min(max(d, 0.05), 0.95)
            context, inverse, kinds = np.unique(own >> BITS, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, weights=n)
            weight = d * kinds / total
            if k == 1:
                below = np.full(len(own), 1 / size)
            else:
                below = lower_p[np.searchsorted(lower_codes, own & ((1 << BITS * (k - 1)) - 1))]
            p = np.maximum(n - d, 0) / total[inverse] + weight[inverse] * below
            self.grams.append((own, np.log(p)))
            self.backs.append((context, np.log(weight)))
            lower_codes, lower_p = own, p


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice) if once and twice else 0.5, 0.05), 0.95)


def tables(scratch: Scratch, counts: DataFrame, langs: int) -> tuple[DataFrame, list[list[int]]]:
    """Model() over tables: lang, kind, code, logs of each language in counts (lang as a number, gram, n0 and on).

    n0 and log0 are of all rows, the others of all but one part. What a part alone has counts 0 without it: its grams
    have there what they back off to, its contexts the weight 1. All but p0 and log0 are kept in single precision.
    Kinds below ORDER are the grams of kind + 1 characters; those from ORDER on the contexts of kind - ORDER + 1.
    With them, how many symbols each language has in each variant.
    """
    every = range(VARIANTS)
    col = lambda name: [F.col(f"{name}{v}") for v in every]
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].withColumn("gram", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)))
        levels[k] = scratch.save(shorter.groupBy("lang", "gram").agg(*(F.count_if(n > 0).alias(f"n{v}") for v, n in enumerate(col("n")))), f"level{k}")
    found, lower, sizes = [], None, []
    for k in range(1, ORDER + 1):
        rare = [F.count_if(n == x).alias(f"{name}{v}") for v, n in enumerate(col("n")) for x, name in ((1, "once"), (2, "twice"))]
        rare = {r["lang"]: r for r in levels[k].groupBy("lang").agg(*rare, *(F.count_if(n > 0).alias(f"size{v}") for v, n in enumerate(col("n")))).collect()}
        if k == 1:
            sizes = [[rare[i][f"size{v}"] for v in every] for i in range(langs)]
        d = [F.element_at(F.array(*[F.lit(_discount(rare[i][f"once{v}"], rare[i][f"twice{v}"])) for i in range(langs)]), F.col("lang") + 1) for v in every]
        contexts = levels[k].groupBy("lang", F.shiftright("gram", BITS).alias("context"))
        contexts = contexts.agg(*(F.count_if(n > 0).alias(f"kinds{v}") for v, n in enumerate(col("n"))), *(F.sum(n).alias(f"total{v}") for v, n in enumerate(col("n"))))
        weights = [F.when(F.col(f"total{v}") > 0, d[v] * F.col(f"kinds{v}") / F.col(f"total{v}")).otherwise(F.lit(1.0)).alias(f"weight{v}") for v in every]
        contexts = scratch.save(contexts.select("lang", "context", *weights, *col("total")), f"contexts{k}")
        own = levels[k].withColumn("context", F.shiftright("gram", BITS))
        own = own.join(F.broadcast(contexts) if k <= 2 else contexts, ["lang", "context"])  # below three at most 1 << BITS a language
        if k == 1:
            below = [F.element_at(F.array(*[F.lit(1 / (sizes[i][v] + 1)) for i in range(langs)]), F.col("lang") + 1) for v in every]
        else:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
            own = own.join(lower.withColumnsRenamed({"gram": "suffix"} | {f"p{v}": f"below{v}" for v in every}), ["lang", "suffix"])
            below = col("below")
        share = [F.when(t > 0, F.greatest(n - d[v], F.lit(0.0)) / t).otherwise(F.lit(0.0)) for v, (n, t) in enumerate(zip(col("n"), col("total")))]
        p = [(s + w * b).cast("float" if v else "double").alias(f"p{v}") for v, (s, w, b) in enumerate(zip(share, col("weight"), below))]
        lower = scratch.save(own.select("lang", "gram", *p), f"p{k}")
        scratch.drop(f"level{k}")
        for kind, table_, code, name in ((k - 1, lower, "gram", "p"), (ORDER + k - 1, contexts, "context", "weight")):
            found.append(table_.select("lang", F.lit(kind).alias("kind"), F.col(code).alias("code"), *(F.log(x).cast("float" if v else "double").alias(f"log{v}") for v, x in enumerate(col(name)))))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out, sizes


class Languages:
    """Published models, which are mapped when first used. With `parted`, costs are also those without each part."""

    def __init__(self, names: list[str], few: list[str] | None = None, files: list[str] | None = None, spans: dict[tuple[int, int], tuple[int, int]] | None = None, sizes: list[list[int]] | None = None):
        self.names, self.few, self.files, self.spans = names, few or [], files or [], spans or {}
        self.sizes = np.array(sizes or [], np.int64).reshape(len(names), VARIANTS)
        self.parted = False
        self.heat, self.power = 1.0, 0.0
        self.lengths, self.ceilings = np.empty(0), np.array([np.inf])
        self._reset()

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def __setstate__(self, state):
        vars(self).update(state)
        self._reset()

    def _reset(self):
        self._columns = len(self.names) * (VARIANTS if self.parted else 1) + 1
        self._room = max(8, min(CACHE, KEPT // self._columns))
        self._at: dict[str, int] = {}
        self._cost = np.zeros((0, self._columns))

    def by_part(self) -> Languages:
        out = copy.copy(self)
        out.parted = True
        out._reset()
        return out

    @property
    def variants(self) -> list[Backoff]:
        """Each language's model of all rows, and beside it those without each part."""
        if "_variants" not in vars(self):
            tables_ = [mapped(self.files, self.spans, i, ORDER, VARIANTS) for i in range(len(self.names))]
            self._variants = [Backoff(grams, backs, BITS, -np.log(size + 1)) for (grams, backs), size in zip(tables_, self.sizes)]
        return self._variants

    @property
    def models(self) -> list[Backoff]:
        """Each language's model of all rows."""
        if "_models" not in vars(self):
            self._models = [m.variant(0) for m in self.variants]
        return self._models

    def _costs(self, words: list[str]) -> np.ndarray:
        """Of each word its negative log probability under each language (and variant of it), and its number of grams."""
        out = np.zeros((len(words), self._columns))
        for codes, of in grams(words, max(1, BLOCK // self._columns)):
            unique, inverse = np.unique(codes, return_inverse=True)
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            own = np.hstack([-m.log_p(unique).reshape(len(unique), -1) for m in (self.variants if self.parted else self.models)])
            out[of[starts], :-1] += np.add.reduceat(own[inverse], starts)
            out[of[starts], -1] += np.diff(np.append(starts, len(of)))
        return out

    def _learn(self, new: list[str]) -> None:
        own = self._costs(new)
        if len(self._at) + len(new) > self._room:
            self._reset()
        base = len(self._at)
        self._at.update(zip(new, range(base, base + len(new))))
        if base + len(new) > len(self._cost):
            room = np.zeros((max(2 * len(self._cost), base + len(new), 4096), self._columns))
            room[:base] = self._cost[:base]
            self._cost = room
        self._cost[base : base + len(new)] = own

    def entropies(self, group: list[list[str]]) -> np.ndarray:
        """Cross-entropy per symbol of each list of words under each column of costs(); NaN without words."""
        costs = self.costs(group)
        return costs[:, :-1] / costs[:, -1:]

    def costs(self, group: list[list[str]]) -> np.ndarray:
        """Negative log probability of each list of words under each language (and variant of it), and its symbols; NaN without words."""
        out = np.full((len(group), self._columns), np.nan)
        new = set().union(*group).difference(self._at)
        any_long = max(map(len, new), default=0) > LONG
        if any_long:
            new = [w for w in new if len(w) <= LONG]
        if new and len(new) <= self._room // 2:
            self._learn(list(new))
        for k, ws in enumerate(group):
            if not ws:
                continue
            long = [w for w in ws if len(w) > LONG] if any_long else []
            total = self._costs(long).sum(axis=0) if long else np.zeros(self._columns)
            short = [w for w in ws if len(w) <= LONG] if long else ws
            for a in range(0, len(short), self._room // 4):
                part = short[a : a + self._room // 4]
                try:
                    at = list(map(self._at.__getitem__, part))
                except KeyError:
                    self._learn([w for w in dict.fromkeys(part) if w not in self._at])
                    if any(w not in self._at for w in part):
                        self._learn([w for w in dict.fromkeys(part) if w not in self._at])
                    at = list(map(self._at.__getitem__, part))
                total += self._cost[at].sum(axis=0)
            out[k] = total
        return out

    def without_part(self, row: np.ndarray, part: int) -> list[float]:
        """What one row of costs() by part has under the models without the part; infinite where that leaves a language nothing."""
        own = row[:-1].reshape(len(self.names), VARIANTS)[:, part + 1]
        return [*np.where(self.sizes[:, part + 1] > 0, own, np.inf), row[-1]]

    def verdict(self, row: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected, from costs under the models of all rows."""
        if len(row) < 2 or np.isnan(row[-1]):
            return "und", 0.0, True
        n = row[-1]
        e = row[:-1] / n
        best = int(e.argmin())
        score = 1 / np.exp(-self.heat * n**self.power * (e - e[best])).sum()
        return self.names[best], float(score), bool(e[best] > self.ceilings[np.searchsorted(self.lengths, _step(n))])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        group = [words_of(t or "") if self.names else [] for t in texts]
        return [self.verdict(row) for row in self.costs(group)] if group else []


def _step(n):
    """Which step of length a number of symbols is in."""
    return np.floor(STEPS * np.log2(n)).astype(np.int64)


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def _part(few: list[str]) -> Column:
    """The part of a row (doc_id, lang): -1 for languages of under FEW rows."""
    return F.when(F.col("lang").isin(few), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(HELD)).cast("int"))


def _number(names: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).cast("int")


def fitted(scratch: Scratch, docs: DataFrame) -> Languages:
    """The models of the rows given. The grams of every labelled row are counted and every gram is kept."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text", "doc_id")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    few = [n for n, size in sizes.items() if size < FEW]
    own = [f"own{p}" for p in range(HELD)]
    counts = labelled.select("lang", _part(few).alias("part"), "text").transform(bounded)
    counts = counts.mapInArrow(_counts, ", ".join(["lang string, gram long, n long", *(f"{c} long" for c in own)]))
    counts = scratch.save(counts.groupBy("lang", "gram").agg(*(F.sum(c).alias(c) for c in ("n", *own))), "grams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not names:
        return Languages(names)
    without = [F.col("n").alias("n0"), *((F.col("n") - F.col(c)).alias(f"n{p + 1}") for p, c in enumerate(own))]
    found, symbols = tables(scratch, counts.select(_number(names).alias("lang"), "gram", *without), len(names))
    scratch.drop("grams")
    used = [f"{t}{k}" for k in range(1, ORDER + 1) for t in ("contexts", "p")]
    return Languages(names, few, *publish(scratch, found, [f"log{v}" for v in range(VARIANTS)], used), symbols)


def measured(docs: DataFrame, languages: Languages, learned: Column) -> DataFrame:
    """doc_id, held_out, costs and samples of every row.

    costs: under each language's model of all rows, and the number of symbols; none without letters. samples, of labelled
    rows for which `learned` holds: the text and its windows, end to end, each as the number of its language, what
    each costs without the row's part, and its symbols.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages.by_part())
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("costs", pa.list_(pa.float64())), ("samples", pa.list_(pa.float64()))])

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, held, texts, langs, parts, hashes = (c.to_pylist() for c in batch.slice(at, 64).columns)
                group, spans = [], []
                for text, y, part, h in zip(texts, langs, parts, hashes):
                    words = words_of(text or "") if own.names else []
                    first = len(group)
                    group.append(words)
                    if y is not None and part >= 0 and words and own.sizes[y, part + 1]:
                        group += [words[(a := (h + n) % (len(words) - n + 1)) : a + n] for n in WINDOWS if n < len(words)]
                        spans.append((first, len(group)))
                    else:
                        spans.append((first, first))
                costs = own.costs(group)
                out = []
                for (first, end), i, h, y, part in zip(spans, ids, held, langs, parts):
                    whole = [] if np.isnan(costs[first, -1]) else [*costs[first, :-1:VARIANTS], costs[first, -1]]
                    out.append((i, h, whole, [x for row in costs[first:end] for x in (float(y), *own.without_part(row, part))]))
                yield table(schema, out)

    y = F.when(F.coalesce(learned, F.lit(False)) & F.col("text").isNotNull(), _number(languages.names)) if languages.names else F.lit(None).cast("int")
    rows_ = docs.withColumn("lang", F.col("lang").cast("string"))
    rows_ = rows_.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_remainder() == 2, F.lit(False)).alias("held"), "text", y.alias("y"), _part(languages.few).alias("part"), F.xxhash64("doc_id").alias("h"))
    return rows_.transform(bounded).mapInArrow(run, "doc_id long, held_out boolean, costs array<double>, samples array<double>")


def _samples(batches, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the samples of measured() (as its only column): language, cross-entropies, symbols, lowest cross-entropy."""
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 2)
        for at in range(0, len(flat), 1 << 14):
            part = flat[at : at + (1 << 14)]
            e, n = part[:, 1:-1] / part[:, -1:], part[:, -1]
            yield part[:, 0].astype(np.int64), e, n, e.min(axis=1)


def calibrate(scratch: Scratch, languages: Languages, samples: DataFrame) -> None:
    """From all samples of measured(): the temperature and its power of the best likelihood, and what REACHED of a length stay under.

    Tasks add up the losses of TRIED, and rows by length and cell of lowest cross-entropy; of the values only those in
    the cells where the bounds fall are ordered. The driver gets a row for each that is tried and each step of length.
    """
    samples, width = samples.select("samples").transform(bounded), len(languages.names)

    def tallied(batches):
        losses, tally = np.zeros(len(TRIED)), Counter()
        for y, e, n, least in _samples(batches, width):
            gap, at = e - least[:, None], np.arange(len(y))
            for power, tried in itertools.groupby(enumerate(TRIED), lambda t: t[1][0]):
                grown = gap * n[:, None] ** power
                for k, (_, heat) in tried:
                    x = -heat * grown
                    losses[k] += np.log(np.exp(x).sum(axis=1)).sum() - x[at, y].sum()
            cells, counts = np.unique(np.stack([_step(n), np.floor(CELLS * least).astype(np.int64)]), axis=1, return_counts=True)
            tally.update(dict(zip(zip(*cells.tolist()), counts.tolist())))
        found = [(-1, k, x) for k, x in enumerate(losses.tolist())] + [(*key, float(x)) for key, x in tally.items()]
        yield table(pa.schema([("step", pa.int64()), ("cell", pa.int64()), ("n", pa.float64())]), found)

    tally = scratch.save(samples.mapInArrow(tallied, "step long, cell long, n double").groupBy("step", "cell").agg(F.sum("n").alias("n")), "tally")
    steps = tally.where("step >= 0").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    if not steps:
        return
    total = sum(r["n"] for r in steps)
    losses = {r["cell"]: round(r["n"] / total, 9) for r in tally.where("step < 0").collect()}
    if width > 1:
        languages.power, languages.heat = TRIED[min(losses, key=lambda k: (losses[k], k))]
    alike = [[]]
    for r in steps:
        if sum(x["n"] for x in alike[-1]) >= ALIKE:
            alike.append([])
        alike[-1].append(r)
    if len(alike) > 1 and sum(x["n"] for x in alike[-1]) < ALIKE:
        alike[-2:] = [alike[-2] + alike[-1]]
    languages.lengths = lengths = np.array([a[-1]["step"] for a in alike[:-1]], np.int64)
    need = [math.ceil(REACHED * sum(x["n"] for x in a)) for a in alike]
    group = F.size(F.filter(F.array(*map(F.lit, lengths.tolist())).cast("array<long>"), lambda x: x < F.col("step")))
    wanted = F.element_at(F.array(*map(F.lit, need)), F.col("alike") + 1)
    cells = tally.where("step >= 0").groupBy(group.alias("alike"), "cell").agg(F.sum("n").alias("n"))
    cells = cells.withColumn("reach", F.sum("n").over(Window.partitionBy("alike").orderBy("cell")))
    crossed = {r["alike"]: (r["cell"], r["before"]) for r in cells.where((F.col("reach") >= wanted) & (F.col("reach") - F.col("n") < wanted)).selectExpr("alike", "cell", "reach - n AS before").collect()}
    crossing = np.array([crossed[g][0] for g in range(len(alike))])

    def near(batches):
        for _, _, n, least in _samples(batches, width):
            own = np.searchsorted(lengths, _step(n))
            hit = np.floor(CELLS * least).astype(np.int64) == crossing[own]
            yield pa.RecordBatch.from_arrays([pa.array(own[hit].astype(np.int32)), pa.array(least[hit])], ["alike", "least"])

    values = samples.mapInArrow(near, "alike int, least double").groupBy("alike", "least").agg(F.count(F.lit(1)).alias("n"))
    before = F.element_at(F.array(*[F.lit(float(crossed[g][1])) for g in range(len(alike))]), F.col("alike") + 1)
    values = values.withColumn("reach", before + F.sum("n").over(Window.partitionBy("alike").orderBy("least")))
    bounds = {r["alike"]: r["least"] for r in values.where(F.col("reach") >= wanted).groupBy("alike").agg(F.min("least").alias("least")).collect()}
    languages.ceilings = np.array([bounds[g] for g in range(len(alike))])
    scratch.drop("tally")


def learn(docs: DataFrame) -> Languages:
    """Fit on the rows given: every labelled row is counted, and every one is measured for the score."""
    scratch = Scratch(docs.sparkSession)
    languages = fitted(scratch, docs)
    calibrate(scratch, languages, scratch.save(measured(docs.where("lang IS NOT NULL"), languages, F.lit(True)), "measured"))
    scratch.drop("measured")
    return languages


def _verdicts(docs: DataFrame, languages: Languages, judge) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of rows (doc_id, held_out and what judge takes a list of)."""
    sent = docs.sparkSession.sparkContext.broadcast(languages)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, held, given = (c.to_pylist() for c in batch.slice(at, 64).columns)
                yield table(schema, [(i, h, *p) for i, h, p in zip(ids, held, judge(own, given))])

    return docs.transform(bounded).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"), "text")
    return _verdicts(docs, languages, Languages.predict)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents whose crc32(doc_id) mod 4 is not 2; predicted for all, whose costs are measured once."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    languages = fitted(scratch, docs.where(_remainder() != 2))
    costs = scratch.save(measured(docs, languages, _remainder() != 2), "measured")
    calibrate(scratch, languages, costs)
    return _verdicts(costs.select("doc_id", "held_out", "costs"), languages, lambda own, given: [own.verdict(np.array(c)) for c in given])
