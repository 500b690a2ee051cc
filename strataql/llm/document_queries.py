"""Problems 6, 7 and 8 on documents, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.llm import mixing
from strataql.llm.residue import residue
from strataql.llm.tokenizer import encode, token_counts
from strataql.session import written
from strataql.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's list of token ids."""
    return encode(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = written(token_counts(table(spark, folder, "documents"), "doc_id", "text", keep=("source",)), "sizes")
    return mixing.mix(sized, table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the mix with the number of times it is used."""
    return _mix(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share that each source reached, beside the one wanted."""
    return _mix(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with template residue, filler, an error page or a demand for scripts."""
    return residue(table(spark, folder, "documents"), "doc_id", "text").filter("n_spans > 0").select(F.col("id").alias("doc_id")).distinct()


def p8_residue(spark: SparkSession, folder: str) -> DataFrame:
    """What was found in each document, and the share of its characters."""
    found = residue(table(spark, folder, "documents"), "doc_id", "text").filter("n_spans > 0")
    return found.select(F.col("id").alias("doc_id"), F.concat_ws(",", "kinds").alias("kinds"), "n_spans", F.round("coverage", 6).alias("coverage"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without any, all columns."""
    documents = table(spark, folder, "documents")
    return documents.join(p8_found(spark, folder), "doc_id", "left_anti")


QUERIES = {"p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_residue": p8_residue, "p8_clean": p8_clean}

SQL: dict[str, str] = {}
