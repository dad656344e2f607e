"""The subpackage's queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name: its module. Each module has a function of the query's name and may have ``ORACLES``.
MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_decontamination": "decontamination",
    "op3_chat_format": "chat_format",
    "op4_token_counts": "token_counts",
    "op5_packing": "packing",
    "op6_ngram_jaccard_join": "ngram_join",
    "op7_secret_scan": "secret_scan",
    "op8_suffix_tree_lm": "suffix_tree_lm",
    "op9_quality_rules": "quality_rules",
    "op10_language_id": "language_id",
    "op11_lexical_search": "lexical_search",
    "op12_quality_svm": "quality_svm",
    "op13_collocations": "collocations",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"netloom.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in dict.fromkeys(MODULES.values()):
        found |= getattr(importlib.import_module(f"netloom.llm.{module}"), "ORACLES", {})
    return found
