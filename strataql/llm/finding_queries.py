"""Problem 5: frequencies of rule ids and severities over all findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.llm.frequencies import frequencies
from strataql.sources.tables import table


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule id and severity with its number of issues and of statements, and its marks."""
    found = frequencies(table(spark, folder, "issues"), ["rule_id", "severity"], "issue_id", "stmt_id")
    return found.withColumnRenamed("n_occurrences", "n_issues").withColumnRenamed("n_records", "n_statements").drop("n_all_records")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each mark of a term that is rare or common."""
    marks = F.explode(F.array_compact(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")))).alias("mark")
    return p5_terms(spark, folder).select("field_name", "term", marks)


QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms}

_TERMS = r"""
WITH v AS (
  SELECT issue_id, stmt_id, 'rule_id' AS field_name, lower(trim(rule_id, e' \t\r\n')) AS term FROM issues
  UNION ALL
  SELECT issue_id, stmt_id, 'severity', lower(trim(severity, e' \t\r\n')) FROM issues),
t AS (
  SELECT field_name, term, count(DISTINCT issue_id) AS n_issues, count(DISTINCT stmt_id) AS n_statements,
    count(DISTINCT issue_id) < 5 AS is_rare,
    count(DISTINCT stmt_id) > 0.2 * (SELECT count(DISTINCT stmt_id) FROM issues) AS is_common
  FROM v WHERE term <> '' GROUP BY ALL)
"""

SQL = {
    "p5_terms": _TERMS + "SELECT * FROM t",
    "p5_found": _TERMS + "SELECT field_name, term, 'rare' AS mark FROM t WHERE is_rare UNION ALL SELECT field_name, term, 'common' FROM t WHERE is_common",
}
