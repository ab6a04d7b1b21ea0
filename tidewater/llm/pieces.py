"""Operator 7: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score, then by place; it merges the first, and offers
the merged symbol's new pairs, until none is left. Symbols without a piece become byte pieces. No piece reaches over
the start of a run of spaces, over a newline or from letters to other characters (the model is checked for that), so
texts are cut there and each distinct chunk is encoded once per worker. Short chunks of an Arrow batch are encoded
side by side: the agenda is then a table of pairs, of which each round merges the first of every chunk. Chunks new to a worker are checked against the sentencepiece library, one call
per Arrow batch; where they differ (none is known) the library's ids hold and the row's n_mismatch counts it.

Null and empty texts have no ids and decode to the empty text. Any code point is allowed; U+2581 is a space to the
library and so it is here. Very long words use a heap, so time stays n log n. Repeated rows give repeated results; other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, documents, rows, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Chunks kept by a worker; symbols beyond which a chunk is encoded by the heap.
CACHE, SHORT = 250_000, 60
#: Chunks encoded and checked together.
PART = 1 << 14
#: No pair.
_NONE = np.int64(1) << 40
_LETTERS = re.compile(r"[^\W\d_]")


def _fields(data: bytes):
    """(number, value) of a protobuf message; values are ints or bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Pieces:
    """A merge-type model: its pieces, and which two symbols merge to which piece."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names, scores, kinds = [], [], []
        self.dummy_prefix, self.extra_spaces = True, True
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    own = dict(_fields(value))
                    names.append(own[1].decode())
                    scores.append(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                    kinds.append(own.get(3, 1))
                elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                    raise ValueError("not a merge-type vocabulary")
                elif number == 3:
                    own = dict(_fields(value))
                    self.dummy_prefix, self.extra_spaces = bool(own.get(3, 1)), not own.get(4, 1)
                    if own.get(2):
                        raise ValueError("models with a normalisation table are not supported")
        if not self.extra_spaces:
            raise ValueError("models that remove spaces are not supported")
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unk = kinds.index(2)
        self.byte = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == 6}
        self.piece = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == 1}
        self.score = np.array(scores, np.float64)
        self.decoded = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds)]
        # digits such as superscripts count as letters in [^\W\d_] but stand beside others in pieces
        odd = "".join(sorted({c for n in self.piece for c in n if _LETTERS.fullmatch(c) and not c.isalpha()}))
        letters, others = rf"[^\W\d_{odd}]", rf"(?:[\d_{odd}]|[^\w \n])"
        #: Newlines, letters and others, each with the run of spaces before it.
        self.cut = re.compile(rf"\n| *{letters}+| *{others}+| +").findall
        alike = re.compile(rf"{letters}*|{others}*|\n")
        for n in self.piece:
            body = n.lstrip(SPACE)
            if SPACE in body or "\n" in n and len(n) > 1 or not alike.fullmatch(body):
                raise ValueError(f"a piece reaches over a place where texts are cut: {n!r}")
        # symbols: pieces by their ids, then characters that are no piece but part of one
        self.symbol = dict(self.piece)
        for n in self.piece:
            for c in n:
                self.symbol.setdefault(c, len(names) + len(self.symbol))
        self.rank = np.argsort(np.argsort(-self.score, kind="stable"), kind="stable").astype(np.int64)
        pairs = sorted((self.symbol[n[:i]] << 32 | self.symbol[n[i:]], p) for n, p in self.piece.items() for i in range(1, len(n)) if n[:i] in self.symbol and n[i:] in self.symbol)
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_to = np.array([p for _, p in pairs], np.int64)
        self.by_rank = np.argsort(self.rank)
        self.merge = dict(pairs)
        self.digits = [str(i) for i in range(len(names))]
        self.cache: dict[str, str] = {}
        self.unlike: dict[str, bytes] = {}

    # ---- encoding

    def _ids(self, symbols, text_of) -> list[int]:
        out = []
        for i, s in enumerate(symbols):
            if 0 <= s < len(self.score):
                out.append(int(s))
            else:
                raw = text_of(i).encode()
                out += [self.byte[b] for b in raw] if self.byte else [self.unk]
        return out

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk (spaces as U+2581), by a heap of pairs."""
        sym = [self.symbol.get(c, -1) for c in chunk]
        n = len(sym)
        size, left, right = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and sym[a] >= 0 and sym[b] >= 0 and (to := self.merge.get(sym[a] << 32 | sym[b])) is not None:
                heapq.heappush(heap, (-self.score[to], a, size[a] + size[b], to))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, length, to = heapq.heappop(heap)
            b = right[a] if size[a] else n
            if not size[a] or b >= n or size[a] + size[b] != length or self.merge.get(sym[a] << 32 | sym[b]) != to:
                continue
            sym[a], size[a], right[a] = to, length, right[b]
            size[b] = 0
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        at, starts = 0, []
        while at < n:
            starts.append(at)
            at = right[at]
        return self._ids([sym[i] for i in starts], lambda i: chunk[starts[i]])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols merge to."""
        keys = a << 32 | b
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[found] == keys) & (a >= 0) & (b >= 0), self.rank[self.pair_to[found]], _NONE)

    def side_by_side(self, chunks: list[str]) -> list[list[int]]:
        """The same for many short chunks: each round merges the best pair of every chunk, the first of equal ones."""
        flat, lengths = "".join(chunks), np.array([len(c) for c in chunks], np.int64)
        sym = np.array([*map(self.symbol.get, flat, repeat(-1))], np.int64)
        starts = np.cumsum(lengths) - lengths
        place, chunk = np.arange(len(flat)), np.arange(len(chunks))
        pair = np.full(len(flat), _NONE)
        pair[:-1] = self._pairs(sym[:-1], sym[1:])
        pair[starts[1:] - 1] = pair[-1:] = _NONE
        done = []
        while len(starts):
            # a chunk's symbols stand together: rank, then place within all symbols
            best = np.minimum.reduceat(pair << 22 | np.arange(len(pair)), starts)
            live = best >> 22 < _NONE
            size = np.diff(np.r_[starts, len(sym)])
            if not live.all():
                end = np.repeat(~live, size)
                done.append((np.repeat(chunk[~live], size[~live]), sym[end], place[end]))
                moved = np.cumsum(~end) - 1
                sym, place, pair = sym[~end], place[~end], pair[~end]
                chunk, size, best = chunk[live], size[live], best[live]
                if not len(chunk):
                    break
                starts = np.cumsum(size) - size
                at = moved[best & (1 << 22) - 1]
            else:
                at = best & (1 << 22) - 1
            sym[at] = self.by_rank[best >> 22]
            last = starts + size - 1
            after = np.where(at + 2 <= last, at + 2, at)
            before = np.where(at > starts, at - 1, at)
            pair[at] = np.where(after > at, self._pairs(sym[at], sym[after]), _NONE)
            pair[before] = np.where(before < at, self._pairs(sym[before], sym[at]), pair[before])
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, place, pair, size = sym[stay], place[stay], pair[stay], size - 1
            starts = np.cumsum(size) - size
        where, sym, place = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 3
        order = np.argsort(where, kind="stable")
        where, sym, place = where[order], sym[order], place[order]
        cuts = np.searchsorted(where, np.arange(len(chunks) + 1)).tolist()
        strange = set(where[(sym < 0) | (sym >= len(self.score))].tolist())
        sym = sym.tolist()
        out = [sym[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in strange:
            at = place[cuts[k] : cuts[k + 1]].tolist()
            out[k] = self._ids(out[k], lambda i, at=at: flat[at[i]])
        return out

    def learn(self, chunks: list[str]) -> int:
        """Encode new chunks into the cache, checked against the library; how many differed."""
        if not chunks:
            return 0
        if len(self.cache) + len(chunks) > CACHE:
            self.cache.clear()
            self.unlike.clear()
        return sum(self._learn_part(chunks[at : at + PART]) for at in range(0, len(chunks), PART))

    def _learn_part(self, chunks: list[str]) -> int:
        spaced = [c.replace(" ", SPACE) for c in chunks]
        short = [c for c in spaced if len(c) <= SHORT]
        digits, decoded = self.digits, self.decoded
        ids = dict(zip(short, self.side_by_side(short))) | {c: self.agenda(c) for c in spaced if len(c) > SHORT}
        wrong = self._check(spaced, ids)
        for c, s in zip(chunks, spaced):
            own = ids[s]
            self.cache[c] = ",".join([digits[i] for i in own])
            if (text := b"".join([decoded[i] for i in own])) != c.encode():
                self.unlike[c] = text
        return wrong

    def _check(self, chunks: list[str], ids: dict[str, list[int]]) -> int:
        """One library call over all chunks, each after a space or a newline as in a text."""
        head = self.library.encode("\n")
        newline = head[1:] if self.dummy_prefix else head
        text, want = ["\n"], list(head)
        for c in chunks:
            if c[0] not in (SPACE, "\n"):
                text.append("\n")
                want += newline
            text.append(c)
            want += ids[c]
        if self.library.encode("".join(text)) == want:
            return 0
        wrong = 0
        for c in chunks:
            own = self.library.encode("\n" + c)[len(head) :]
            if own != ids[c] and c != "\n":
                ids[c], wrong = own, wrong + 1
        return wrong

    def chunks(self, text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        return self.cut(" " + text if self.dummy_prefix and text else text)

    def encode(self, text: str) -> list[int]:
        parts = self.chunks(text)
        return [int(i) for i in self.found(parts)[0].split(",")] if parts else []

    def found(self, parts: list[str]) -> tuple[str, int, str, int]:
        """Ids joined by commas, their number, the text that they decode to, and chunks unlike the library's."""
        cache, ids, texts, wrong = self.cache, [], [], 0
        for at in range(0, len(parts), CACHE // 4):
            own = parts[at : at + CACHE // 4] if at or len(parts) > CACHE // 4 else parts
            try:
                ids += [cache[c] for c in own]
            except KeyError:
                wrong += self.learn([c for c in dict.fromkeys(own) if c not in cache])
                wrong += self.learn([c for c in dict.fromkeys(own) if c not in cache])  # the cache was emptied meanwhile
                ids += [cache[c] for c in own]
            texts += [self.unlike.get(c) or c.encode() for c in own] if self.unlike else own
        ids = ",".join(ids)
        raw = self.text_of(texts) if not self.unlike else self.text_of([t if isinstance(t, bytes) else t.encode() for t in texts])
        return ids, ids.count(",") + bool(ids), raw, wrong

    # ---- decoding

    def decode(self, ids: list[int]) -> str:
        return self.text_of([self.decoded[i] for i in ids])

    def text_of(self, parts: list) -> str:
        """Text of decoded pieces or chunks, str or bytes; the space that was put before the text goes."""
        if parts and isinstance(parts[0], str):
            text = "".join(parts)
        else:
            text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


#: Chunks looked up together.
GROUP = 100_000


def coded(path: str | None, batches, of):
    """Lists of of(doc_id, ids joined by commas, number of ids, decoded text, chunks unlike the library's)."""
    model = pieces(path or model_path())
    for batch in batches:
        group, size = [], 0
        for doc_id, text in rows(batch, step=32):
            group.append((doc_id, model.chunks(text or "")))
            size += len(group[-1][1])
            if size >= GROUP:
                yield _flush(model, group, of)
                group, size = [], 0
        yield _flush(model, group, of)
        pa.default_memory_pool().release_unused()


def _flush(model: Pieces, group: list, of) -> list:
    cache = model.cache
    new = list({c for _, parts in group for c in parts if c not in cache})
    wrong = model.learn(new) if len(new) < CACHE // 2 else 0
    out = []
    for doc_id, parts in group:
        ids, n, text, own = model.found(parts)
        out.append(of(doc_id, ids, n, text, wrong + own))
        wrong = 0
    return out


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_mismatch of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_mismatch", pa.int64())])

    def run(batches):
        def of(doc_id, ids, n, text, wrong):
            return doc_id, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), wrong

        for done in coded(path, batches, of):
            yield table(schema, done)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_mismatch long")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
