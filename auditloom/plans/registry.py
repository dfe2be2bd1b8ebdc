"""The registered queries and, where SQL can express them, their DuckDB twins."""

from auditloom.plans import pages, scans, sites, streams, tables, texts

MODULES = (pages, scans, sites, streams, tables, texts)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
