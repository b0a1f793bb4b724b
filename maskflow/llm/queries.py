"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_token_output", "op2_token_counts", "op3_ngram_jaccard", "op4_quality", "op5_chat", "op6_sentencepiece", "op7_toxicity", "op8_mixing", "op9_ann", "op10_language"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
