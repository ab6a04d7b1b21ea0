"""Operator 4: license scans by fuzzy short-notice search.

Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. The base labels are exact phrases of
words. On top, each notice of NOTICES is searched with up to k = len // ERROR_EVERY edits over the words joined by
single spaces: cut into k + 1 seeds, an occurrence holds at least one of them unchanged (pigeonhole), so exact seeds
found by an Aho-Corasick automaton locate the candidates, and the regex library's bounded-error matching verifies each
and gives its span, in code points of the text.

Null and empty texts have no words, no labels and score 0. Repeated rows give repeated results; other columns are
ignored. Hits in very long texts are verified in windows that overlap only where the hits do. Notices that fit the same
words all count; spans go by start, end and label. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, documents, rows, table

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices as words, by label; a label may have several.
NOTICES = {
    "apache": "licensed under the apache license version 2 0",
    "apache-text": "you may not use this file except in compliance with the license",
    "mit": "released under the mit license",
    "mit-terms": "licensed under the terms of the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-clause": "neither the name of the copyright holder nor the names of its contributors may be used",
    "bsd-use": "use of this source code is governed by a bsd style license",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl": "under the terms of the gnu lesser general public license",
    "agpl": "under the terms of the gnu affero general public license",
    "fdl": "under the terms of the gnu free documentation license",
    "mpl": "subject to the terms of the mozilla public license",
    "epl": "made available under the terms of the eclipse public license",
    "cddl": "subject to the terms of the common development and distribution license",
    "cc": "this work is licensed under a creative commons attribution",
    "cc-by-text": "creative commons attribution 4 0 international license",
    "cc-by-sa": "creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nc-text": "creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd": "creative commons attribution noderivatives 4 0 international license",
    "cc0": "dedicated to the public domain under the cc0 1 0 universal",
    "isc": "permission to use copy modify and or distribute this software for any purpose",
    "zlib": "permission is granted to anyone to use this software for any purpose",
    "boost": "distributed under the boost software license version 1 0",
    "artistic": "under the terms of the artistic license 2 0",
    "psf": "licensed under the python software foundation license",
    "odbl": "made available under the open database license",
    "ofl": "this font software is licensed under the sil open font license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public-domain": "this work is in the public domain in its country of origin",
    "proprietary": "no part of this publication may be reproduced distributed or transmitted in any form",
}
#: One edit is allowed for so many characters of a notice.
ERROR_EVERY = 16

_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> bytes:
    """Lower-cased words joined by single spaces."""
    return b" ".join(text.translate(_WORDS).split())


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def in_text(text: str, spans: list[tuple]) -> list[tuple]:
    """Spans over the joined words (their second and third fields) as spans over the text."""
    words = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    starts = [0, *accumulate(b - a + 1 for a, b in words)]
    out = []
    for label, a, b, *more in spans:
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        if a - starts[first] >= words[first][1] - words[first][0]:  # the space after a word
            first, a = first + 1, starts[first + 1]
        own, end = words[first][0] + a - starts[first], words[last][0] + b - starts[last]
        out.append((label, own, min(end, words[last][1]), *more))
    return out


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice cut into k + 1 parts of about equal length, with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def merged(windows: list[tuple[int, int]]) -> list[list[int]]:
    """Disjoint windows that cover the same places. Later seeds may start earlier ones, so they are sorted first."""
    out: list[list[int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


class Notices:
    def __init__(self, notices: dict[str, str], error_every: int = ERROR_EVERY):
        self.found = [(label, text, k := len(text) // error_every, regex.compile(f"(?e)(?:{regex.escape(text)}){{e<={k}}}")) for label, text in notices.items()]
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k, _) in enumerate(self.found):
            for at, seed in seeds(text, k):
                by_seed.setdefault(seed, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for seed, places in by_seed.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def search(self, joined: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) of each occurrence; offsets in the joined words."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.automaton.iter(joined):
            for n, at in places:
                _, text, k, _ = self.found[n]
                start = end + 1 - length - at
                lo, hi = max(0, start - 2 * k), min(len(joined), start + len(text) + 2 * k)
                windows.setdefault(n, []).append((lo, hi))
        out = []
        for n, own in windows.items():
            label, text, k, pattern = self.found[n]
            for lo, hi in merged(own):
                for m in pattern.finditer(joined, lo, hi):
                    edits = sum(m.fuzzy_counts)
                    out.append((label, m.start(), m.end(), edits, 1 - edits / len(text)))
        return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


@lru_cache(maxsize=4)
def notices(found: tuple = tuple(NOTICES.items()), error_every: int = ERROR_EVERY) -> Notices:
    return Notices(dict(found), error_every)


_BASE = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]


def scan(text: bytes, search) -> tuple:
    joined = words_of(text)
    padded = b" " + joined + b" "
    starts, labels = [], set()
    for phrase, label in _BASE:
        at, word, counted = padded.find(phrase), 0, 0
        while at >= 0:
            word, counted = word + padded.count(b" ", counted, at), at
            starts.append(word)
            labels.add(label)
            at = padded.find(phrase, at + 1)
    spans = search(joined.decode())
    score = 1.0 if labels else max((s[4] for s in spans), default=0.0)
    every = labels | {s[0] for s in spans}
    shown = ",".join(f"{label}:{a}:{b}:{edits}" for label, a, b, edits, _ in (in_text(text.decode(), spans) if spans else ()))
    n = joined.count(b" ") + bool(joined)
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, shown


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])


def scan_licenses(docs: DataFrame, found: dict[str, str] = NOTICES, error_every: int = ERROR_EVERY) -> DataFrame:
    """Figures, labels, score and spans (label:start:end:edits, in code points of the text) of every document."""
    key = tuple(found.items())

    def run(batches):
        search = notices(key, error_every).search
        for batch in batches:
            yield table(_SCHEMA, [(doc_id, *scan(text or b"", search)) for doc_id, text in rows(batch, "text")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
