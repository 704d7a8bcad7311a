"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_fingerprint": "fingerprint",
    "op2_suffix_tree": "suffix_tree",
    "op3_decontaminate": "decontaminate",
    "op4_licenses": "licenses",
    "op5_quality": "quality",
    "op6_html": "html",
    "op7_near_dup": "near_dup",
    "op9_substrings": "substrings",
    "op8_token_output": "token_output",
    "op10_packing": "packing",
    "op11_collocations": "collocations",
    "op12_personal_data": "personal_data",
    "op13_centroids": "centroids",
}
#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}
