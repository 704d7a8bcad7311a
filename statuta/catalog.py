"""The library's queries by name, with their DuckDB SQL."""

from __future__ import annotations

from .plans import anchor_queries, base, book_queries, edit_queries, gate_queries, ledger_queries, markup_queries, more_queries, outline_queries, promote_queries, result_queries, review_queries, rule_queries, source_queries, stream_queries, text_queries  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
