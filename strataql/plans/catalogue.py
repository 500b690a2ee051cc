"""All named queries of the core."""

from __future__ import annotations

from strataql.plans import examples, issues, project, relational, rules, views

MODULES = [rules, issues, project, relational, views, examples]

FLAGSHIP = "findings_by_dimension"


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
