"""Operators of a training-data pipeline: token counts and files, text filters, near copies, mixing."""

from __future__ import annotations

import importlib

#: Modules with registered queries.
FAMILIES = (
    "op_token_counts", "op_tokens", "op_language", "op_html", "op_mixing", "op_quality", "op_substring", "op_toxicity", "op_ngram_join", "op_decontamination",
    "op_filter_audit", "op_alignment", "op_embedding_graph",
)


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"wardline.llm.{name}")


def queries() -> dict:
    from wardline.llm.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from wardline.llm.registry import SQL

    _load()
    return dict(SQL)
