"""Rules that need all statements of a project: unused objects, duplicates, unreachable code, cross-file breaks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataql.operators.splitting import split

# Words that are never taken for an object's name.
NO_OBJECT = ("SELECT", "FROM", "WHERE", "AND", "OR", "IN", "NULL", "AS", "CREATE", "VIEW", "PROCEDURE", "FUNCTION", "INT", "INTEGER", "BEGIN", "END", "RETURN", "RETURNS", "PROCEDURE_NAME", "TABLE_NAME")

DEFINITION = r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?(VIEW|PROCEDURE|PROC|FUNCTION|TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[\w\"`\[\]]+\.)?[\"`\[]?(\w+)"


def unused_objects(statements: DataFrame, scope: list[str], key: str = "stmt_id") -> DataFrame:
    """QUAL-DEAD-001: definitions of views, procedures, functions and tables whose name no other statement of the scope has.

    An anti join on names: definitions against the words of all other statements. A statement's own
    text doesn't use the object; a second definition of the same name does. Literals and comments
    count as text, names without case.
    """
    texts = statements.filter("raw IS NOT NULL")
    defined = texts.select(*scope, F.col(key).alias("def_key"), F.upper(F.regexp_extract("raw", DEFINITION, 1)).alias("object_kind"), F.upper(F.regexp_extract("raw", DEFINITION, 2)).alias("name"))
    defined = defined.filter((F.col("name") != "") & ~F.col("name").isin(*NO_OBJECT))
    used = texts.select(*scope, F.col(key).alias("use_key"), F.explode(F.array_distinct(F.regexp_extract_all(F.upper("raw"), F.lit(r"[A-Z_][A-Z0-9_]*"), F.lit(0)))).alias("name"))
    # Only words that are names of objects go on, and of each at most two users: one may be the definition itself.
    names = defined.select(*scope, "name").distinct()
    users = used.join(names, [*scope, "name"], "left_semi").groupBy(*scope, "name").agg(F.min("use_key").alias("first_use"), F.max("use_key").alias("last_use"))
    return (
        defined.join(users, [*scope, "name"], "left")
        .filter("first_use IS NULL OR (first_use = def_key AND last_use = def_key)")
        .select(*scope, F.col("def_key").alias(key), "object_kind", "name")
    )


def masked(raw: Column) -> Column:
    """A statement's text with literals as ? and white space collapsed; identifiers keep their case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"'(?:[^']|'')*'", "?"), r"\b\d+(?:\.\d+)?\b", "?"), r"\s+", " "))


def duplicates(statements: DataFrame, order: list[str], key: str = "stmt_id", scope: tuple[str, ...] = ()) -> DataFrame:
    """QUAL-DEAD-003: statements whose masked text an earlier one has, with the number of all: key, n_copies.

    DDL doesn't count. The first of each group is the smallest by `order`, found by an aggregation
    that combines before the shuffle, so that a text which recurs in a third of all rows is no
    single task's sort.
    """
    texts = statements.filter("raw IS NOT NULL").filter(~F.upper("raw").rlike(r"CREATE |ALTER |DROP ")).withColumn("print", F.sha2(masked(F.col("raw")), 256))
    groups = texts.groupBy(*scope, "print").agg(F.count("*").alias("n_copies"), F.min_by(key, F.struct(*order)).alias("first_key")).filter("n_copies > 1")
    return texts.select(*scope, "print", key).join(groups, [*scope, "print"]).filter(F.col(key) != F.col("first_key")).select(key, "n_copies")


_RETURN = re.compile(r"^\s*RETURN\b", re.IGNORECASE)


def unreachable(text: str) -> list[str]:
    """Statements of a routine's block that stand behind a RETURN of the same block."""
    if not re.search(r"\bBEGIN\b", text, re.IGNORECASE) or not re.search(r"\b(?:PROCEDURE|FUNCTION|PROC)\b", text, re.IGNORECASE):
        return []
    start = re.search(r"\bBEGIN\b", text, re.IGNORECASE).end()
    ends = [m.start() for m in re.finditer(r"\bEND\b", text, re.IGNORECASE) if m.start() > start]
    body = text[start : ends[-1]] if ends else text[start:]
    out, returned = [], False
    for raw, *_ in split(body):
        if returned and raw.strip("; \n\t") and raw.strip().upper() not in ("END", "GO", "END;"):
            out.append(raw)
        returned = returned or bool(_RETURN.match(raw))
    return out


def _unreachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(k, i, s) for k, t in zip(pdf["key"], pdf["raw"]) for i, s in enumerate(unreachable(t))]
        yield pd.DataFrame(rows, columns=["key", "ordinal", "snippet"])


def unreachable_code(statements: DataFrame, key: str = "stmt_id") -> DataFrame:
    """QUAL-DEAD-002: key, ordinal, snippet of code behind a RETURN."""
    chosen = statements.filter(F.col("raw").rlike(r"(?i)\bRETURN\b")).select(F.col(key).alias("key"), "raw")
    return chosen.mapInPandas(_unreachable, f"key {statements.schema[key].dataType.simpleString()}, ordinal int, snippet string").withColumnRenamed("key", key)


def cross_file_breaks(drops: DataFrame, uses: DataFrame) -> DataFrame:
    """SCH-BRK-001: drops (scope, key, table_name, column_name or null) that other statements of the scope still use: n_uses.

    `uses` has scope, key, table_name and columns. Uses are counted by (scope, table, column) before
    they meet the drops, and the dropping statement's own are taken off, so that a table which a
    third of all statements reads is one row a column, not a pair a statement. Names compare without case.
    """
    u = uses.select("scope", "key", F.lower("table_name").alias("table_name"), F.transform("columns", F.lower).alias("columns"))
    # A statement uses a table as a whole once, and each of its columns once.
    each = u.select("scope", "key", "table_name", F.explode(F.array_union(F.array(F.lit(None).cast("string")), F.coalesce("columns", F.array().cast("array<string>")))).alias("column_name")).distinct()
    d = drops.select("scope", "key", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")).distinct()
    wanted = d.select("scope", "table_name", "column_name").distinct()
    on = ["scope", "table_name"]

    def same(a: DataFrame, b: DataFrame) -> Column:
        return (a.scope == b.scope) & (a.table_name == b.table_name) & a.column_name.eqNullSafe(b.column_name)

    kept = each.join(wanted, same(each, wanted), "left_semi")
    counts = kept.groupBy(*on, "column_name").agg(F.count("*").alias("n"))
    own = kept.withColumn("own", F.lit(1))
    met = d.join(counts, same(d, counts)).select(d["*"], "n")
    less = met.join(own, same(met, own) & (met.key == own.key), "left").select(met["*"], F.coalesce("own", F.lit(0)).alias("own"))
    return less.withColumn("n_uses", F.col("n") - F.col("own")).filter("n_uses > 0").select("scope", "key", "table_name", "column_name", "n_uses")
