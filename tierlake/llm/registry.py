"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name: module that has it as a function; ORACLE_SQL of the module may have its SQL.
MODULES = {
    "op1_digest": "digest",
    "op2_simhash": "simhash",
    "op3_language": "language",
    "op4_packing": "packing",
    "op5_bpe_codec": "bpe",
    "op6_secrets": "secrets",
    "op7_quality": "quality",
    "op8_warc": "warc",
    "op9_substring": "substring",
    "op10_topk": "topk",
    "op11_merkle": "merkle",
    "op12_interpolated": "interpolated",
    "op13_centroids": "centroids",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}).get(name) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
