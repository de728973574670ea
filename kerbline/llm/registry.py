"""The queries of this folder and, where SQL expresses them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_decontamination",
    "op2_ngram_jaccard_join",
    "op3_url_filters",
    "op4_packing",
    "op5_chat_formatting",
    "op6_quality",
    "op7_fingerprints",
    "op8_toxicity",
    "op9_pii",
    "op10_warc",
    "op11_hard_negatives",
    "op12_collocations",
    "op13_token_ids",
)


def queries() -> dict:
    return {name: getattr(import_module(f"kerbline.llm.{name}"), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"kerbline.llm.{name}"), "ORACLE_SQL", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
