"""All queries of the library (the text operators have their own list), and their SQL."""

from __future__ import annotations

from tidelog.plans import collection_queries, config_queries, custody_queries, evidence_queries, host_queries, ingest_queries, link_queries, report_queries

MODULES = [host_queries, evidence_queries, config_queries, ingest_queries, link_queries, custody_queries, report_queries, collection_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
