"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from importlib import import_module

#: Query, module.
_OPS = {
    "op1_licenses": "licenses",
    "op2_mixing": "mixing",
    "op3_neardup_vectors": "neardup_vectors",
    "op4_packing": "packing",
    "op5_sharding": "sharding",
    "op6_substrings": "substrings",
    "op7_langid": "langid",
    "op8_jaccard": "jaccard",
    "op9_fingerprints": "fingerprints",
    "op10_brown": "brown",
}


def queries() -> dict:
    return {name: getattr(import_module(f"sedira.llm.{module}"), name) for name, module in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _OPS.items():
        if sql := getattr(import_module(f"sedira.llm.{module}"), f"ORACLE_{name.split('_')[0].upper()}", None):
            out[name] = sql
    return out
