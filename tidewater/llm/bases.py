"""What SQL can say of operators 3, 4, 5, 6 and 8: their base columns as queries of their own, through the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, secrets, token_counts, urls
from .common import documents


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, source_size and target of operator 3."""
    found = mixing.targets(mixing._sized(documents(spark, sf_dir).select("doc_id", "source", "text")))
    return found.select("source", "source_size", F.round("target", 3).alias("target"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of operator 4."""
    return licenses.op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words by source and language, as operator 5's ledger has them after all batches."""
    return token_counts.op5_token_counts(spark, sf_dir).where(F.col("tokenizer") == token_counts.WORDS).select("source", "lang", "docs", "tokens")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path and rule of operator 6, and the verdict where a rule gives it."""
    found = urls.op6_urls(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of base spans of operator 8."""
    return secrets.scan_secrets(documents(spark, sf_dir), base_only=True).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (mixing_targets, license_phrases, word_totals, url_rules, secret_patterns)}

_SIZE = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _either(word: str) -> str:
    """The word's letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"list_filter(range(1, len(ws) + 1), lambda i: {same})"


def _longest() -> str:
    """The rule of a url: longest first, so that the first that fits holds."""
    cases = []
    for rule in sorted(urls.RULES, key=lambda r: (-len(r), r)):
        host, slash, tail = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash + tail}') THEN '{rule}'")
    return "CASE " + " ".join(cases) + " END"


_VERDICTS = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in urls.RULES.items())

SQL = {
    "mixing_targets": f"""
WITH per AS (SELECT source, CAST(sum({_SIZE}) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, CAST(list_extract([1, 2, 3], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM per),
r AS (SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level FROM r WINDOW p AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT level FROM l WHERE level <= ratio ORDER BY nth LIMIT 1)
SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM first), CAST('inf' AS DOUBLE)) * w), 3) AS target FROM l
""",
    "license_phrases": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, {", ".join(f"{_places(phrase)} AS p{k}" for k, phrase in enumerate(licenses.PHRASES))} FROM d),
a AS (SELECT *, list_concat(p0, list_concat(p1, p2)) AS hits FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base, CAST(list_min(hits) - 1 AS BIGINT) AS first_word, CAST(list_max(hits) - 1 AS BIGINT) AS last_word,
  concat_ws(',', {", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(licenses.PHRASES.values()))}) AS base_labels FROM a
""",
    "word_totals": f"SELECT source, lang, count(*) AS docs, CAST(sum({_SIZE}) AS BIGINT) AS tokens FROM documents GROUP BY source, lang",
    "url_rules": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{_CAPITALS}', '{_SMALL}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {_longest()} AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {_VERDICTS} END AS verdict FROM r
""",
    "secret_patterns": rf"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM documents
""",
}
