"""From raw documents to token counts: quality rules, exact dedup, near-dedup, source mix, SentencePiece.

Every stage takes documents (doc_id, text, lang, source, n_chars and any other columns) as its predecessor left them and
all but the last return them with the same columns; run() returns doc_id, n_tokens, ids_sha256, decoded_sha256 and
n_mismatch. Rows are told apart by what they hold, so rows that repeat a doc_id, or lack one, are decided one by one.

Null, empty and short texts go with the quality rules, so no later stage of run() has any; a stage that is called by
itself takes them as its operator does: as empty texts, of which one stays per group. Nulls in source make a source of
their own, the last; nulls in other columns are kept. Texts are read whole, however long. Of ties the smallest doc_id
stays, of equal rows one. Names of columns may clash with any that the operators use. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common, exact_dedup, mixing, pieces, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources", mix), ("SentencePiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's documents."""
    scratch, docs = common.Scratch(spark), common.documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{n}")
            if n:
                scratch.drop(f"stage{n - 1}")
    return docs


#: The near-dedup hashes with XXH64 and the last stage runs a vocabulary: not for SQL; tests hold run() against plain Python.
ORACLE_SQL = None
