"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

import importlib

#: (query name, module); each module has ``query(spark, sf_dir)`` and ORACLE_SQL (or None).
_OPERATORS = [
    ("op1_near_duplicates", "minhash"),
    ("op2_warc", "warc"),
    ("op3_fingerprints", "fingerprints"),
    ("op4_language_id", "language_id"),
    ("op5_personal_data", "pii"),
    ("op6_packing", "packing"),
    ("op7_quality_rules", "quality_rules"),
    ("op8_toxicity", "toxicity"),
    ("op9_mixing", "mixing"),
    ("op10_line_dedup", "line_dedup"),
    ("op11_lexical_search", "lexical"),
    ("op12_periodic_runs", "periodic"),
    ("op13_token_store", "token_store"),
]


def queries() -> dict:
    return {name: importlib.import_module(f"convsift.llm.{module}").query for name, module in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {name: importlib.import_module(f"convsift.llm.{module}").ORACLE_SQL for name, module in _OPERATORS}
    return {name: sql for name, sql in found.items() if sql}
