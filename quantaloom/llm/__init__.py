"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from quantaloom.llm import chat_format, decontaminate, exact_dedup, license_scan, packing, secret_scan, sharding, simhash, token_counts, toxicity

MODULES = (simhash, license_scan, packing, chat_format, decontaminate, toxicity, exact_dedup, sharding, token_counts, secret_scan)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
