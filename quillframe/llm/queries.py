"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name to the module that defines it.
MODULES = {
    "op1_token_orc": "token_store",
    "op2_spotsigs": "spotsigs",
    "near_duplicate_classes": "spotsigs",
    "op3_byte_bpe": "byte_bpe",
    "op4_maxent_lm": "maxent_lm",
    "op5_mix_sources": "mixing",
    "op6_ngram_join": "ngram_join",
    "op7_token_counts": "token_counts",
    "op8_main_text": "main_text",
    "op9_substring_dedup": "substring_dedup",
    "op10_quality_rules": "quality",
    "op11_vector_codes": "vector_codes",
    "op12_lexical_search": "lexical",
    "op13_language_id": "language_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries."""
    return {name: getattr(import_module(f"quillframe.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows, for the queries that have it."""
    return {name: getattr(module, "ORACLE_SQL") for name, m in MODULES.items() if hasattr(module := import_module(f"quillframe.llm.{m}"), "ORACLE_SQL")}
