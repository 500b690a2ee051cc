"""Dialect names: aliases, detection by voting, and the gate of dialect-specific rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shorthand names of dialects.
ALIASES = {"postgres": "postgresql", "pg": "postgresql", "mssql": "tsql", "sqlserver": "tsql", "sql_server": "tsql", "mariadb": "mysql", "bq": "bigquery", "sf": "snowflake"}
# Further spellings that occur in corpora.
SPELLINGS = {"t-sql": "tsql", "sqlite3": "sqlite"}

# Canonical dialects.
CANONICAL = ("postgresql", "mysql", "tsql", "oracle", "sqlite", "bigquery", "snowflake", "redshift", "clickhouse", "duckdb", "presto", "trino", "spark", "databricks")

# Votes for a dialect, in the order that decides ties.
VOTES = {
    "bigquery": [r"`[\w-]+`\.`[\w-]+`", r"`[\w-]+\.[\w-]+\.[\w-]+`"],
    "postgresql": [r"::", r"\$\d+"],
    "mysql": [r"`"],
    "tsql": [r"\[", r"\]", r"\bTOP\s+\d+"],
    "oracle": [r"\bROWNUM\b"],
    "snowflake": [r"\bLATERAL\s+FLATTEN\b"],
}


def canonical_dialect(name: Column) -> Column:
    """The canonical name: trimmed, lower case, aliases resolved; null where there is none."""
    low = F.lower(F.trim(name))
    names = F.create_map(*[F.lit(x) for pair in (ALIASES | SPELLINGS).items() for x in pair])
    return F.when(low == "", None).otherwise(F.coalesce(names[low], low))


def canonical_dialect_sql(name: str) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (ALIASES | SPELLINGS).items())
    return f"nullif(CASE lower(trim({name})) {whens} ELSE lower(trim({name})) END, '')"


def votes(text: Column) -> dict[str, Column]:
    return {d: sum((text.rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0)) for d, patterns in VOTES.items()}


def detect_dialect(text: Column) -> Column:
    """The dialect with most votes, ties by the order of VOTES; null without any vote."""
    scores = votes(text)
    best = F.greatest(*scores.values())
    out = None
    for d, score in scores.items():
        out = F.when((best > 0) & (score == best), d) if out is None else out.when((best > 0) & (score == best), d)
    return out


def detect_dialect_sql(text: str) -> str:
    scores = {d: "(" + " + ".join("regexp_matches({}, '{}', 'i')::INT".format(text, p) for p in ps) + ")" for d, ps in VOTES.items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    return f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {s} = {best} THEN '{d}'" for d, s in scores.items()) + " END"


def gate(dialect: Column, dialects: list[str]) -> Column:
    """Whether a rule for `dialects` runs: always for none, never where the statement's dialect is unknown."""
    return F.lit(True) if not dialects else F.coalesce(dialect.isin(*dialects), F.lit(False))


def gate_sql(dialect: str, dialects: list[str]) -> str:
    return "TRUE" if not dialects else f"coalesce({dialect} IN ({', '.join(repr(d) for d in dialects)}), FALSE)"
