"""All registered queries of the analytics engine and their SQL counterparts."""

from __future__ import annotations

from . import q_dedup, q_records, q_retrieval, q_rules, q_store, q_warehouse

MODULES = (q_retrieval, q_dedup, q_warehouse, q_records, q_rules, q_store)


def queries() -> dict:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
