"""Small tables and plain versions of the operators."""

import random

WORDS = "alpha beta gamma delta omega river stone cloud paper light table chair green quiet".split()


def table(spark, rows, extra=""):
    """documents from (doc_id, text, lang, source) rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], schema)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_documents():
    """Nulls in each column, empty and blank and very long texts, ties, repeated rows."""
    long_text = prose(5, 30_000)
    return [
        (1, "a b c", "en", "x"),
        (2, "a  b\nc", "en", "x"),
        (3, "abc", None, "y"),
        (3, "abc", None, "y"),
        (4, None, "en", "x"),
        (5, "", "de", None),
        (6, " \t\n", "de", None),
        (None, "abc", "en", "x"),
        (None, None, None, None),
        (7, long_text, "en", "x"),
        (8, long_text + ".", "en", "x"),
        (9, "\u00e9\u00e8 \u4e2d\u6587 \U0001f600 \u00a0x\u2003y", "fr", "z"),
        (10, "z" * 5000, "fr", "z"),
    ]
