"""Operator 8: secret scans by a linear-chain conditional random field over the base patterns.

Base patterns (assign, access, hex) are matched in the whole text. The field tags every token of it as begin, inside or
outside of a secret: words of letters, digits, +/_.- and characters beyond ASCII, and each other mark by itself. Features
are a token's shape, the neighbouring tokens and features of the file (never the base match itself). All tokens are
scored; by these scores, tokens in no stretch whose bound reaches that of staying outside cannot be inside a secret under
the fitted weights, so that Viterbi over the stretches that are left decodes the whole text exactly.

The weights are fitted with forward-backward gradients on a bounded sample, TRAIN_RUNS pieces of PIECE tokens. A quarter
are pieces with a base label, out of about TRAIN_DOCS documents chosen by a hash of their doc_id; a quarter are their
copies with the keyword hidden, where the value looks like a secret by itself. A quarter have no label, by a hash of
document and place; the last are their copies with a made-up secret planted, or a made-up harmless look-alike. So the
field learns values by their look and not only by what the patterns go by. Pieces weigh by how rarely they are drawn.

Null and empty texts have no spans; an empty table gives an empty result. Without a labelled piece no span is added.
Repeated rows give repeated results; other columns are ignored. Spans of the method that overlap a base span are left out;
of labels that score alike the first of begin, inside, outside is taken. Texts of any length are tagged whole; of a
shape of many changes the first six and their number's size count, and of a neighbouring token the last twelve bytes. A field can be written and read again, see
write_field(), so that it is fitted once.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, Scratch, bounded, code_points, documents, rows, table

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
TRAIN_DOCS, TRAIN_RUNS, EPOCHS, RATE, L2 = 200_000, 12_000, 60, 0.5, 1e-4
PIECE = 16
#: Distinct tokens whose scores a worker keeps.
CACHE = 300_000
MIN_CHARS = 8
B, I, O = 0, 1, 2

_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_DIGITS = re.compile(rb"[0-9]+")
_CHARS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_NOT_CHARS = re.compile(rb"[^A-Za-z0-9+/_.=-]")
_LETTER = re.compile(rb"[A-Za-z]")
_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LOWER = bytes(0x39 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else c for c in range(256))
#: What own features but entropy and hex tell apart of a byte.
_CLASS = bytes(0x39 if 48 <= c < 58 else 0x41 if 65 <= c < 91 else 0x61 if 97 <= c < 123 else 0x2D if c in _CHARS else 0x2A for c in range(256))
_BITS = [0.0, *[c * log2(c) for c in range(1, 257)]]
_HEXED = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))


def base_spans(text: bytes) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value) in bytes, by start, then kind."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in text.translate(_HEXED):
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(out)]


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Runs of MIN_CHARS and more with a letter and a digit, the usual look of a secret: a feature, no condition."""
    out, after = [], 0
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        if a < after:
            continue
        while a > after and text[a - 1] in _CHARS:
            a -= 1
        stop = _NOT_CHARS.search(text, b)
        b = stop.start() if stop else len(text)
        after = b
        if b - a >= MIN_CHARS and _LETTER.search(text, a, b):
            out.append((a, b))
    return out


_TOKENS = re.compile(rb"[A-Za-z0-9+/_.\x80-\xff-]+|[^\x20\x09-\x0D]")
#: 0 in spaces, 1 in words, 2 for marks that stand alone.
_KIND = np.array([0 if c in b" \t\n\x0b\x0c\r" else 1 if c >= 128 or c in b"+/_.-" or chr(c).isalnum() else 2 for c in range(256)], np.uint8)


def _shape(token: bytes) -> str:
    kinds = ["9" if 48 <= c < 58 else "A" if 65 <= c < 91 else "a" if 97 <= c < 123 else "-" for c in token]
    shape = "".join(k for k, before in zip(kinds, [None, *kinds]) if k != before)
    return shape if len(shape) <= 6 else f"{shape[:6]}~{len(shape).bit_length()}"


def _word(token: bytes) -> bytes:
    return token[-12:].translate(_LOWER)


def _entropy(token: bytes) -> int:
    """Twice the entropy of a token's bytes, in whole bits."""
    counts = map(token.count, set(token))
    sums = map(_BITS.__getitem__, counts) if len(token) <= 256 else (c * log2(c) for c in counts)
    return int(2 * (log2(len(token)) - sum(sums) / len(token)) + 1e-9)


def own_features(token: bytes) -> list[str]:
    n = len(token)
    digits = len(token) - len(token.translate(None, b"0123456789"))
    return [
        "bias",
        f"shape={_shape(token)}",
        f"len={min(n // 2, 24)}",
        f"entropy={_entropy(token)}",
        f"digits={digits * 5 // n}",
        f"hex={not token.translate(None, b'0123456789abcdef')}",
        f"upper={not token.translate(None, b'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')}",
        f"marks={len(token.translate(None, _ALNUM)) * 4 // n}",
        f"usual={bool(candidates(token))}",
    ]


def near_features(token: bytes) -> list[str]:
    """What a token says of those one, two and three after it and of the one before it."""
    word = _word(token).decode("latin-1")
    return [f"before={word}", f"before2={word}", f"before3={word}", f"next={word}"]


def tight_features(before: bool, after: bool) -> list[str]:
    return [f"glue={bool(before)}", f"after={bool(after)}"]


def file_features(text: bytes) -> list[str]:
    low = text.lower()
    return [f"file-key={any(k in low for k in _KEYWORDS)}", f"file-lines={min(text.count(b'\n').bit_length(), 8)}", f"file-equals={min(text.count(b'=').bit_length(), 6)}"]


def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every token."""
    kind = np.zeros(len(text) + 2, np.uint8)
    kind[1:-1] = _KIND[np.frombuffer(text, np.uint8)]
    alone, inside = kind == 2, kind == 1
    starts = np.flatnonzero(alone[1:] | inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(alone[:-1] | inside[:-1] & ~inside[1:])
    return starts, ends


def tokens(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Every token with its start and end."""
    return _TOKENS.findall(text), *places(text)


def labels(starts: np.ndarray, ends: np.ndarray, base: list) -> np.ndarray:
    """By the base patterns: begin at a value's first token, inside after it."""
    own = np.full(len(starts), -1)
    for k in reversed(range(len(base))):
        _, _, e, v = base[k]
        own[np.searchsorted(ends, v, "right") : np.searchsorted(starts, e)] = k
    return np.where(own < 0, O, np.where(own == np.r_[-1, own[:-1]], I, B))


# ---- the field

_START = np.array([0.0, -np.inf, 0.0])
_ALLOWED = np.array([[0, 0, 0], [0, 0, 0], [0, -np.inf, 0]], float)  # outside to inside is barred


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Field:
    """Linear-chain CRF; every run begins after and ends before an outside token."""

    def __init__(self, index: dict[str, int], state: np.ndarray, move: np.ndarray):
        self.index, self.state, self.move = index, state, move

    def scores(self, run: list[list[str]]) -> np.ndarray:
        return np.array([self.state[[self.index[f] for f in fs if f in self.index]].sum(axis=0) if fs else np.zeros(3) for fs in run])

    def viterbi(self, run: list[list[str]]) -> list[int]:
        return self.decode(self.scores(run))

    def decode(self, s: np.ndarray) -> list[int]:
        if not len(s):
            return []
        move = self.move + _ALLOWED
        best, back = s[0] + move[O], []
        for row in s[1:]:
            x = best[:, None] + move
            back.append(x.argmax(axis=0))
            best = x.max(axis=0) + row
        best = best + move[:, O]
        out = [int(best.argmax())]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]

    @classmethod
    def fit(cls, data: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, weights: list[float] | None = None) -> Field | None:
        """Adagrad on the regularised conditional log-likelihood; runs of one length go through forward-backward together."""
        weights = [1.0] * len(data) if weights is None else weights
        if not data:
            return None
        index: dict[str, int] = {}
        for run, _ in data:
            for fs in run:
                for f in fs:
                    index.setdefault(f, len(index))
        state, move = np.zeros((len(index), 3)), np.zeros((3, 3))
        g_state, g_move = np.full_like(state, 1e-6), np.full_like(move, 1e-6)
        by_length: dict[int, list] = {}
        for (run, y), weight in zip(data, weights):
            by_length.setdefault(len(run), []).append(([[index[f] for f in fs] for fs in run], y, weight))
        packs = []
        for length, group in by_length.items():
            token = np.repeat(np.arange(len(group) * length), [len(fs) for run, _, _ in group for fs in run])
            ids = np.array([i for run, _, _ in group for fs in run for i in fs])
            packs.append((length, len(group), token, ids, np.array([y for _, y, _ in group]), np.array([w for _, _, w in group])))
        total = sum(weights)
        for _ in range(epochs):
            d_state, d_move = -L2 * total * state, -L2 * total * move
            for length, n, token, ids, y, w in packs:
                s = np.stack([np.bincount(token, weights=state[ids, k], minlength=n * length) for k in range(3)], axis=1).reshape(n, length, 3)
                m = move + _ALLOWED
                fwd = np.empty_like(s)
                fwd[:, 0] = s[:, 0] + m[O]
                for t in range(1, length):
                    fwd[:, t] = s[:, t] + _logsumexp(fwd[:, t - 1][:, :, None] + m, 1)
                bwd = np.empty_like(s)
                bwd[:, -1] = m[:, O]
                for t in range(length - 2, -1, -1):
                    bwd[:, t] = _logsumexp(m + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                z = _logsumexp(fwd[:, -1] + m[:, O], 1)
                p = np.exp(fwd + bwd - z[:, None, None])
                err = ((np.eye(3)[y] - p) * w[:, None, None]).reshape(n * length, 3)
                for k in range(3):
                    d_state[:, k] += np.bincount(ids, weights=err[token, k], minlength=len(index))
                d_move[O] += err.reshape(n, length, 3)[:, 0].sum(axis=0)
                d_move[:, O] += err.reshape(n, length, 3)[:, -1].sum(axis=0)
                for t in range(1, length):
                    pair = (np.exp(fwd[:, t - 1][:, :, None] + m + (s[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]) * w[:, None, None]).sum(axis=0)
                    np.add.at(d_move, (y[:, t - 1], y[:, t]), w)
                    d_move -= pair
            g_state += d_state**2
            g_move += d_move**2
            state += RATE * d_state / np.sqrt(g_state)
            move += RATE * d_move / np.sqrt(g_move)
        return cls(index, state, move)


def _share(name: str) -> float:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=7).digest(), "big") / 2**56


_SAMPLE = pa.schema([("labelled", pa.bool_()), ("rank", pa.float64()), ("tokens", pa.list_(pa.binary())), ("tight", pa.list_(pa.bool_())), ("y", pa.list_(pa.int64())), ("file", pa.list_(pa.string()))])


def _samples(batches, share: float):
    """Pieces with a base label of all documents, those without of a share of them; three tokens before and one after stand by."""
    for batch in batches:
        out = []
        for doc_id, text in rows(batch, "text"):
            text = text or b""
            base = base_spans(text)
            drawn = _share(str(doc_id)) < share
            if not (base or drawn):
                continue
            own, starts, ends = tokens(text)
            y, file = labels(starts, ends, base), file_features(text)
            tight = np.r_[False, starts[1:] == ends[:-1], False]
            padded = [b"", b"", b"", *own, b""]
            for at in range(0, len(own), PIECE):
                part = y[at : at + PIECE].tolist()
                labelled = any(k != O for k in part)
                if labelled or drawn:
                    part[0] = B if part[0] == I else part[0]
                    out.append((labelled, _share(f"{doc_id}:{at}"), padded[at : at + len(part) + 4], tight[at : at + len(part) + 1].tolist(), part, file))
        yield table(_SAMPLE, out)


# ---- made-up secrets and what looks like them

_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def made_up(rng: np.random.Generator) -> bytes:
    """A random string of one of the looks that keys and passwords have."""
    draw = lambda letters, n: "".join(rng.choice(list(letters), int(n)))
    n = rng.integers(16, 49)
    look = rng.integers(0, 8)
    if look == 0:
        out = draw(_BASE62, n)
    elif look == 1:
        parts = [draw(_BASE62 + "-_", n)]
        for _ in range(int(n) % 3):  # some are put together by dots
            parts.append(draw(_BASE62 + "-_", rng.integers(10, 64)))
        out = ".".join(parts)
    elif look == 2:
        out = draw(_BASE62 + "+/", 4 * (n // 4)) + "=" * int(rng.integers(0, 3))
    elif look == 3:
        out = draw("0123456789abcdef", rng.integers(16, 24))
    elif look == 4:
        out = draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", n)
    elif look == 5:
        out = draw("abcdefghijklmnopqrstuvwxyz", rng.integers(2, 5)) + "_-"[int(rng.integers(0, 2))] + draw(_BASE62, n)
    elif look == 6:
        out = "-".join(draw("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", 5) for _ in range(int(rng.integers(3, 6))))
    else:
        out = draw("abcdefghijklmnopqrstuvwxyz0123456789", n)
    return out.encode()


def harmless(rng: np.random.Generator, words: list[bytes]) -> bytes:
    """What is no secret and may look like one: numbers, dates, versions, addresses, names of words from the text."""
    n = lambda a, b: str(int(rng.integers(a, b)))
    word = lambda: words[int(rng.integers(0, len(words)))].decode("utf-8", "ignore") if words else "word"
    look = rng.integers(0, 8)
    if look == 0:
        out = n(10**6, 10**15)
    elif look == 1:
        out = f"{n(1970, 2040)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}.{n(10, 60)}"
    elif look == 2:
        out = f"v{n(0, 30)}.{n(0, 99)}.{n(0, 999)}"
    elif look == 3:
        step = lambda: [word(), word()[:2], n(1, 9999), f"{word()}-{word()}", f"{word()}_{word()[:1]}"][int(rng.integers(0, 5))]
        out = ["https://www.", "//", "/", "www."][int(rng.integers(0, 4))] + f"{word()}.{word()[:3]}/" + "/".join(step() for _ in range(int(rng.integers(1, 6)))) + ["", ".html", "/"][int(rng.integers(0, 3))]
    elif look == 4:
        out = "_".join(word() for _ in range(int(rng.integers(2, 5))))
    elif look == 5:
        out = "".join(word().capitalize() for _ in range(int(rng.integers(2, 4)))) + n(1, 99)
    elif look == 6:
        out = "-".join(word() for _ in range(int(rng.integers(2, 4))))
    else:
        out = f"+{n(1, 99)}-{n(100, 999)}-{n(1000, 9999)}-{n(100, 999)}"
    return out.encode()


def _planted(rng: np.random.Generator, t: list[bytes], tight: list[bool], y: list[int], file: list[str]) -> tuple:
    """The piece with a made-up string between two of its tokens; three tokens stand before it and one after."""
    at = int(rng.integers(3, len(t)))
    secret = rng.random() < 0.6
    own = _TOKENS.findall(made_up(rng) if secret else harmless(rng, [w for w in t if w.isalpha() and len(w) > 2]))
    marks = [B, *[I] * (len(own) - 1)] if secret else [O] * len(own)
    k = at - 3
    beside = list(tight)
    beside[k : k + 1] = [False, *[True] * (len(own) - 1), False]
    return [*t[:at], *own, *t[at:]], beside, [*y[:k], *marks, *y[k:]], file


#: Total weight of the copies, beside all others.
COPIES = 0.1


def train(docs: DataFrame, limit: int = TRAIN_RUNS) -> Field | None:
    scratch = Scratch(docs.sparkSession)
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    part = min(1.0, TRAIN_DOCS / max(1, n))
    cut = min(int(-(2**63) + part * 2**64), 2**63 - 1)
    chosen = docs.where(F.xxhash64(F.col("doc_id").cast("long")) <= F.lit(cut))
    # about three times the pieces wanted, at eight bytes a token
    share = min(1.0, 3 * limit * PIECE * 8 / max(1, part * (size or 0)))
    found = chosen.select("doc_id", "text").transform(bounded).mapInArrow(lambda b: _samples(b, share), "labelled boolean, rank double, tokens array<binary>, tight array<boolean>, y array<long>, file array<string>")
    found = scratch.save(found, "pieces")
    data, weights, copies = [], [], []
    own, near = functools.cache(own_features), functools.cache(lambda t: [sys.intern(f) for f in near_features(t)])

    def features(t, tight, file, without=lambda w: False):
        said = lambda w, k: [] if without(w) else [near(w)[k]]
        return [[*own(t[k]), *said(t[k - 1], 0), *said(t[k - 2], 1), *said(t[k - 3], 2), *said(t[k + 1], 3), *tight_features(*tight[k - 3 : k - 1]), *file] for k in range(3, len(t) - 1)]

    keyword = lambda w: any(k in w.lower() for k in _KEYWORDS)
    for labelled in (True, False):
        sample = found.where(F.col("labelled") == labelled).orderBy("rank", F.to_json(F.struct("tokens"))).limit(limit // 4).collect()
        reached = sample[-1]["rank"] if sample and len(sample) == limit // 4 else 1.0
        if labelled and not sample:
            break
        for r in sample:
            t, tight, y, file = list(map(bytes, r["tokens"])), list(r["tight"]), list(r["y"]), list(map(sys.intern, r["file"]))
            data.append((features(t, tight, file), y))
            weights.append(1 / max(reached, 1e-9) / (1 if labelled else share))
            if labelled:
                if all(candidates(w) for w, k in zip(t[3:], y) if k == B):
                    copies.append((features(t, tight, [f for f in file if not f.startswith("file-key")], keyword), y))
            else:
                t, tight, y, file = _planted(np.random.default_rng(int(_share(repr(t)) * 2**53)), t, tight, y, file)
                copies.append((features(t, tight, file), y))
    scratch.drop("pieces")
    if not data:
        return None
    own_weight = COPIES * sum(weights) / max(1, len(copies))
    return Field.fit(data + copies, weights=weights + [own_weight] * len(copies))


class Tagger(dict):
    """Tags whole texts by a field, with scores relative to outside.

    Token to the number of its own features' score (upper 32 bits) and of its score as a neighbour (lower). Tokens of
    one look share their own score; neighbours the field does not know share number 0.
    """

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        move = field.move + _ALLOWED - field.move[O, O]
        self.move = np.maximum(move[:, :2].max(axis=0) + np.maximum(move[:2, O], 0), -1e9)
        self.tight = np.array([[self._sum([tight_features(x, x)[k]]) for x in (False, True)] for k in (0, 1)])
        known = [f.split("=", 1)[1].encode("latin-1") for f in field.index if f.split("=", 1)[0] in ("before", "before2", "before3", "next")]
        self.words = {w: k for k, w in enumerate(dict.fromkeys(known), 1)}
        self.near = np.zeros((len(self.words) + 1, 4, 2))
        for word, k in self.words.items():
            self.near[k] = [self._sum([f]) for f in near_features(word)]
        self.looks: dict[tuple, int] = {}
        self.own = np.zeros((1024, 2))
        self[b""] = self.words.get(b"", 0)  # beyond a text; scored as a neighbour only

    def _sum(self, found: list[str]) -> np.ndarray:
        at = [self.field.index[f] for f in found if f in self.field.index]
        total = self.field.state[at].sum(axis=0)
        return total[:2] - total[O]

    def __missing__(self, token: bytes) -> int:
        look = token.translate(_CLASS), not token.translate(None, b"0123456789abcdef"), _entropy(token)
        at = self.looks.get(look)
        if at is None:
            at = self.looks[look] = len(self.looks)
            if at == len(self.own):
                self.own = np.concatenate([self.own, np.zeros_like(self.own)])
            self.own[at] = self._sum(own_features(token))
        out = self[token] = at << 32 | self.words.get(_word(token), 0)
        return out

    def relative(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]], list]:
        """The scores of begin and inside against outside of all tokens; of each text, where its tokens are, and their places.

        The texts stand side by side, with three empty tokens before each and one after the last.
        """
        if len(self) > CACHE:
            self.clear()
            self.looks.clear()
            self[b""] = self.words.get(b"", 0)
        every, spans, where, n = [], [], [], 0
        gap = [b""] * 3
        for text in texts:
            own = _TOKENS.findall(text)
            every += gap
            every += own
            spans.append((n + 3, n + 3 + len(own)))
            where.append(places(text))
            n += 3 + len(own)
        every.append(b"")
        at = np.fromiter(map(self.__getitem__, every), np.int64, len(every))
        near = self.near[at & 0xFFFFFFFF]
        s = self.own[at >> 32]
        for k in (1, 2, 3):
            s[k:] += near[:-k, k - 1]
        s[:-1] += near[1:, 3]
        tight = np.zeros(len(every) + 1, np.int64)  # whether a token touches the one before it
        for (a, b), (starts, ends) in zip(spans, where):
            tight[a + 1 : b] = starts[1:] == ends[:-1]
        s += self.tight[0][tight[:-1]] + self.tight[1][tight[1:]]
        s += np.repeat([self._sum(file_features(text)) for text in [*texts, b""]], [b - a + 3 for a, b in spans] + [1], axis=0)
        return s, spans, where

    def stretches(self, s: np.ndarray) -> list[tuple[int, int]]:
        """Stretches beyond which no token is in a block whose bound reaches that of staying outside."""
        bound = (s + self.move).max(axis=1)
        if not len(bound) or bound.max() < -1e-6:
            return []
        total = np.cumsum(bound)
        left = total - np.minimum.accumulate(np.concatenate([[0], total[:-1]]))  # best sum that ends here
        right = np.maximum.accumulate(total[::-1])[::-1] - np.concatenate([[0], total[:-1]])  # best sum that starts here
        open_ = np.concatenate([[False], left + right - bound >= -1e-6, [False]])
        edges = np.flatnonzero(open_[1:] != open_[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist()))

    def spans(self, texts: list[bytes]) -> list[list[list[int]]]:
        """Of each text the spans of its secrets."""
        s, spans, where = self.relative(texts)
        best, out = (s + self.move).max(axis=1), []
        for (first, last), (starts, ends) in zip(spans, where):
            found: list[list[int]] = []
            if last > first and best[first:last].max() >= -1e-6:
                own = s[first:last]
                for a, b in self.stretches(own):
                    for k, label in enumerate(self.field.decode(np.c_[own[a:b], np.zeros(b - a)]), a):
                        if label == B:
                            found.append([int(starts[k]), int(ends[k])])
                        elif label == I:
                            found[-1][1] = int(ends[k])
            out.append(found)
        return out


def scan(text: bytes, field: Field | Tagger | None) -> tuple:
    return next(scans([text], field))


#: Bytes tagged together.
GROUP = 1 << 17


def scans(texts: Iterable[bytes], field: Field | Tagger | None) -> Iterator[tuple]:
    """n_assign, n_access, n_hex, base_sha256, spans, n_crf of each text, tagged side by side."""
    tagger = Tagger(field) if isinstance(field, Field) else field
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP:
            yield from map(_scanned, group, tagger.spans(group) if tagger is not None else [()] * len(group))
            group, size = [], 0
    yield from map(_scanned, group, tagger.spans(group) if tagger is not None and group else [()] * len(group))


def _scanned(text: bytes, found: list[list[int]]) -> tuple:
    base, own = base_spans(text), []
    if found:
        # base spans by start: of those that start before a span's end, the farthest end
        starts, reach = [s for s, *_ in base], list(accumulate((e for _, _, e, _ in base), max))
        own = [(a, "crf", b, a) for a, b in found if not ((k := bisect_left(starts, b)) and reach[k - 1] > a)]
    every = sorted([*base, *own], key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    offsets = sorted({x for s, _, e, _ in every for x in (s, e)})
    counts = accumulate(code_points(text[a:b]) for a, b in zip([0, *offsets], offsets))
    at = dict(zip(offsets, counts))
    show = lambda spans: ",".join(f"{k}:{at[s]}:{at[e]}" for s, k, e, _ in spans)
    n = [sum(k == kind for _, k, _, _ in every) for kind in KINDS]
    return *n[:3], hashlib.sha256(show(base).encode()).hexdigest(), show(every), n[3]


_STORED = "feature string, `begin` double, inside double, outside double"


def write_field(spark: SparkSession, field: Field, path: str) -> None:
    """A row for each feature, and one for the moves from each label."""
    weights = [(name, *map(float, field.state[k])) for name, k in field.index.items()]
    moves = [(f"\x00move{k}", *map(float, row)) for k, row in enumerate(field.move)]
    spark.createDataFrame(weights + moves, _STORED).coalesce(1).write.parquet(path)


def read_field(spark: SparkSession, path: str) -> Field:
    found = {r["feature"]: tuple(r)[1:] for r in spark.read.schema(_STORED).parquet(path).collect()}  # at most TRAIN_RUNS runs' features
    move = np.array([found.pop(f"\x00move{k}") for k in range(3)])
    return Field({f: k for k, f in enumerate(found)}, np.array(list(found.values())).reshape(-1, 3), move)


def scan_secrets(docs: DataFrame, field: Field | None = None, base_only: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf of every document; without a field one is fitted first.

    base_only: the base patterns alone, without a field.
    """
    spark = docs.sparkSession
    field = train(docs) if field is None and not base_only else field
    sent = spark.sparkContext.broadcast(field)  # at most TRAIN_RUNS runs' features
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())])

    def run(batches):
        own = sent.value and Tagger(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = (text or b"" for text in part.column(1).cast(pa.binary()).to_pylist())
                yield table(schema, [(doc_id, *found) for doc_id, found in zip(part.column(0).to_pylist(), scans(texts, own))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
