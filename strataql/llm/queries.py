"""All named queries of this subpackage."""

from __future__ import annotations

from strataql.llm import document_queries, finding_queries, statement_queries

MODULES = [statement_queries, finding_queries, document_queries]
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
