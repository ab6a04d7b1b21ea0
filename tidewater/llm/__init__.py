"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import bases, chat, exact_dedup, language, licenses, mixing, pieces, quality, ranking, secrets, simhash, token_counts, urls, variants

_MODULES = (exact_dedup, quality, mixing, licenses, token_counts, urls, pieces, secrets, simhash, language, variants, chat, ranking)


def queries() -> dict:
    return {k: v for module in _MODULES for k, v in vars(module).items() if k.startswith("op") and k[2:3].isdigit()} | bases.QUERIES


def oracle_sql() -> dict:
    return {"op1_exact_dedup": exact_dedup.SQL, "op2_quality": quality.SQL, "op12_chat": chat.SQL, "op13_search": ranking.SQL, **bases.SQL}
