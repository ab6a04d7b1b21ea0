"""Operator 2: quality rules, line first.

Each \\n-split line with a word is held against punctuation, navigation and boilerplate rules; lines that fail go. A
document whose failed lines hold more than MAX_LOST of its words is rejected, and so is one that fails the base rules
(under 50 words, or over half of its words inside repeated 3-word windows).

Null and empty texts have no words: they fail the base rules. Lines without a word are neither failed nor counted.
Texts of any length are judged whole; an empty table gives an empty result. Repeated rows are judged alike, row by row; other columns are ignored by quality(), and kept by clean_documents().
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded, code_points, documents, rows, table

MIN_WORDS, MAX_LOST = 50, 0.5
SYMBOLS = b"#*$%&|<>"
#: Marks that separate the entries of a menu.
NAV_MARKS = ("|", "»", "›", "•", "·")
#: A line of under SHORT words has to end in one of these.
SHORT, ENDS = 4, tuple(".!?:;…\"')]”’»")
BOILERPLATE = ("cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "read more", "sign up for our newsletter", "subscribe to our newsletter", "follow us on", "share this article", "skip to content", "back to top")
BOILERPLATE_WORDS = 30

_SHOUT = re.compile(rb"[!?]{2,}")
_NAV = tuple(x.encode() for x in NAV_MARKS)
_ENDS = tuple(x.encode() for x in ENDS)
_PHRASES = tuple(x.encode() for x in BOILERPLATE)


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols >= 3 and 10 * symbols > sum(map(code_points, words)):
        return "symbols"
    shouts = len(_SHOUT.findall(line))
    if shouts >= 2 and 5 * shouts >= n:
        return "shouting"
    marks = sum(map(line.count, _NAV))
    if marks >= 3 and 5 * marks >= n:
        return "navigation"
    if n < SHORT and not words[-1].endswith(_ENDS):
        return "fragment"
    if n <= BOILERPLATE_WORDS:
        low = line.lower()
        if any(p in low for p in _PHRASES):
            return "boilerplate"
    return None


def repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, marked = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            marked[i : i + 3] = b"\1\1\1"
    return sum(marked)


def judge(text: bytes) -> tuple[dict, bytes]:
    """Figures and verdict of a text, and the text without its failed lines."""
    words = text.split()
    n = len(words)
    lines, seen, dup, lost, kept_lines = text.split(b"\n"), set(), 0, 0, []
    for line in lines:
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            if line_fails(line, own):
                lost += len(own)
                continue
        kept_lines.append(line)
    repeat = repeated(words)
    failed = n < MIN_WORDS or 100 * repeat > 50 * n
    return {
        "n_words": n,
        "word_chars": code_points(text.translate(None, SPACES)),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "lost_words": lost,
        "base_failed": failed,
        "kept": not failed and lost <= MAX_LOST * n,
    }, text if len(kept_lines) == len(lines) else b"\n".join(kept_lines)


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept"]
_TYPES = {"base_failed": "boolean", "kept": "boolean"}


def _judged(batches):
    schema = pa.schema([("doc_id", pa.int64()), *((f, pa.bool_() if f in _TYPES else pa.int64()) for f in _FIELDS)])
    for batch in batches:
        yield table(schema, [(doc_id, *judge(text or b"")[0].values()) for doc_id, text in rows(batch, "text")])


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and the figures and verdict of every document."""
    schema = "doc_id long, " + ", ".join(f"{f} {_TYPES.get(f, 'long')}" for f in _FIELDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(_judged, schema)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns, without their failed lines; n_chars follows the text where there is one."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                verdicts = [judge(x or b"") for x in part.column(at).cast(pa.binary()).to_pylist()]
                stay = [v["kept"] for v, _ in verdicts]
                texts = pa.array([t for (v, t) in verdicts if v["kept"]], pa.binary()).cast(pa.string())
                columns = [c.filter(pa.array(stay, pa.bool_())) for c in part.columns]
                columns[at] = texts
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    # by place, as names with dots cannot be sent to Arrow
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = placed.transform(bounded).mapInArrow(run, placed.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


_ANY = "(" + " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE) + ")"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
word AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
win AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g FROM word WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) > 1 AS hit FROM win WHERE g IS NOT NULL),
marked AS (SELECT DISTINCT rid, i + k AS i FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE hit),
rep AS (SELECT rid, count(*) AS n FROM marked GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(regexp_extract_all(line, '[!?][!?]+')) AS shouts, len(regexp_extract_all(line, '[|»›•·]')) AS marks FROM line),
lf AS (SELECT rid, line, len(ws) AS n,
         (symbols >= 3 AND 10 * symbols > length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))
         OR (shouts >= 2 AND 5 * shouts >= len(ws)) OR (marks >= 3 AND 5 * marks >= len(ws))
         OR (len(ws) < {SHORT} AND NOT regexp_matches(ws[len(ws)], '[.!?:;…"'')\]”’»]$'))
         OR (len(ws) <= {BOILERPLATE_WORDS} AND {_ANY}) AS fails
       FROM lw WHERE len(ws) > 0),
per AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost_words FROM lf GROUP BY rid),
f AS (SELECT d.doc_id, CAST(len(words.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(per.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(per.lost_words, 0) AS BIGINT) AS lost_words
      FROM d JOIN words USING (rid) LEFT JOIN per USING (rid) LEFT JOIN rep USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= {MAX_LOST} * n_words AS kept
FROM f
"""
