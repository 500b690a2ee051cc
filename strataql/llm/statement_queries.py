"""Problems on statements, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.llm.copies import copy_classes, copy_members
from strataql.llm.secrets import redacted, secrets
from strataql.llm.validity import file_validity, rates
from strataql.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every statement that is a copy of an earlier one, with the one kept."""
    return copy_members(table(spark, folder, "statements"), "stmt_id", "raw")


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct statement once, with the number of its copies."""
    classes, _ = copy_classes(table(spark, folder, "statements"), "stmt_id", "raw")
    return classes.select("keep_id", "n_copies", F.sha2("form", 256).alias("form_sha"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return file_validity(table(spark, folder, "statements"), table(spark, folder, "schemas"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with at least one statement that is not valid in its repository's language."""
    return _files(spark, folder).filter("n_bad > 0").select(F.col("repo").alias("repo_id"), "file")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files, bad files and the rate of bad files by repository and language."""
    return rates(_files(spark, folder)).withColumnRenamed("repo", "repo_id")


#: The two places in which secrets are looked for: table, id column, text column.
PLACES = (("statements", "stmt_id", "raw"), ("issues", "issue_id", "snippet"))


def _in_places(spark: SparkSession, folder: str, operator) -> DataFrame:
    first, second = (operator(table(spark, folder, t), i, c).select(F.lit(t).alias("place"), F.col("id").alias("row_id"), "*").drop("id") for t, i, c in PLACES)
    return first.unionByName(second)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every statement and every finding that holds a secret; a finding delivered twice counts once."""
    return _in_places(spark, folder, secrets).select("place", "row_id").distinct()


def p4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The list of secrets by kind and position; the secrets themselves are not repeated."""
    return _in_places(spark, folder, secrets).distinct()


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """All statements and findings with only their secrets masked."""
    return _in_places(spark, folder, redacted)


QUERIES = {"p4_found": p4_found, "p4_secrets": p4_secrets, "p4_redacted": p4_redacted, "p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found, "p3_classes": p3_classes}

SQL: dict[str, str] = {}
