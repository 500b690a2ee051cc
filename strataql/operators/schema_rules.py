"""Rules that compare statements with a schema or with each other: one finding a row, with what to say and do.

The schema is read off the DDL of the same scope (a project, a repository, a migration chain); a
scope without any has no schema, and none of its statements is compared with one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataql.operators.project import cross_file_breaks, duplicates, unreachable_code, unused_objects
from strataql.operators.schema import breaking_changes, ddl_events, history
from strataql.operators.structure import _ctes, _frames, words

_REFERENCE = "array<struct<qualifier:string,name:string,clause:string,key:string,aliased:boolean>>"
_USES = f"scope string, seq long, tables array<string>, aliases map<string,string>, refs {_REFERENCE}, nested boolean"


def references(text: str) -> tuple[list[str], dict[str, str], list[tuple], bool] | None:
    """(tables, table by alias, column references, whether queries are nested) of a query or DML; None for DDL and other text.

    Names of common table expressions and templates are no tables.
    """
    w = words(text)
    up = [x.upper() for x in w]
    if not up or up[0] not in ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "MERGE", "("):
        return None
    found = _frames(w)
    ctes = _ctes(w, up)
    tables, aliases = [], {}
    for f in found:
        named = list(f["table_aliases"])
        for t in f["tables"]:
            if t in ctes or t.startswith("__jinja"):
                continue
            if t not in tables:
                tables.append(t)
            aliases[t] = t
        if len(f["tables"]) == len(named):
            aliases |= dict(zip(named, f["tables"]))
        elif len(f["tables"]) == 1 and named:
            aliases[named[0]] = f["tables"][0]
    refs = [r for f in found for r in f["refs"]]
    return tables, aliases, refs, bool(ctes) or any(f["role"] == "subquery" for f in found)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for scope, seq, raw in zip(pdf["scope"], pdf["seq"], pdf["raw"]):
            found = references(raw) if raw else None
            if found:
                rows.append((scope, seq, *found))
        yield pd.DataFrame(rows, columns=["scope", "seq", "tables", "aliases", "refs", "nested"])


def uses(statements: DataFrame) -> DataFrame:
    """What each query or DML among (scope, seq, raw) reads: tables, aliases, column references."""
    return statements.select("scope", "seq", "raw").mapInPandas(_scan, _USES)


def _finding(df: DataFrame, rule_id: str, message: Column, snippet: Column, fix: Column | None = None, replacement: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("scope", "seq", F.lit(rule_id).alias("rule_id"), message.alias("message"), snippet.alias("snippet"), (none if fix is None else fix).alias("fix"), (none if replacement is None else replacement).alias("replacement"))


def _lower(column: str) -> Column:
    return F.lower(F.col(column))


def schema_findings(read: DataFrame, objects: DataFrame) -> DataFrame:
    """SCHEMA-TBL-001, SCHEMA-COL-001 and SCHEMA-IDX-001 of statements' reads against the objects of their scope's schema.

    A qualified column is looked up in the table of that name, an unqualified one in all tables of
    the statement that the schema has, unless queries are nested. Columns of a WHERE need an index
    on just them; a JSON column that is looked into needs one of its own kind. Names compare without case.
    """
    tables = objects.filter("kind = 'table'").select("scope", _lower("table_name").alias("table_name")).distinct()
    columns = objects.filter("kind = 'column'").select("scope", _lower("table_name").alias("table_name"), _lower("name").alias("name")).distinct()
    indexed = objects.filter("kind = 'index'").filter(F.size("columns") == 1).select("scope", _lower("table_name").alias("table_name"), F.lower(F.col("columns")[0]).alias("name"))
    keys = objects.filter("kind = 'column' AND (primary_key OR is_unique)").select("scope", _lower("table_name").alias("table_name"), _lower("name").alias("name"))
    known = read.join(tables.select("scope").distinct(), "scope", "left_semi")
    asked = known.select("scope", "seq", F.explode("tables").alias("table_name"))
    missing = asked.join(tables, ["scope", "table_name"], "left_anti").distinct()
    out = _finding(missing, "SCHEMA-TBL-001", F.format_string("Table '%s' is not in the schema", "table_name"), F.col("table_name"))

    refs = known.select("scope", "seq", "tables", "aliases", "nested", F.explode("refs").alias("r")).select("scope", "seq", "tables", "aliases", "nested", "r.*").filter("NOT aliased")
    qualified = refs.filter("qualifier <> ''").select("scope", "seq", F.col("qualifier").alias("table_name"), "name").distinct()
    wrong = qualified.join(tables, ["scope", "table_name"], "left_semi").join(columns, ["scope", "table_name", "name"], "left_anti")
    out = out.unionByName(_finding(wrong, "SCHEMA-COL-001", F.format_string("Column '%s' is not in table '%s'", "name", "table_name"), F.concat_ws(".", "table_name", "name")))
    bare = refs.filter("qualifier = '' AND NOT nested").select("scope", "seq", "name", F.explode("tables").alias("table_name")).distinct()
    there = columns.withColumn("found", F.lit(True))
    lost = (
        bare.join(tables, ["scope", "table_name"], "left_semi")
        .join(there, ["scope", "table_name", "name"], "left")
        .groupBy("scope", "seq", "name")
        .agg(F.max("found").alias("found"), F.array_sort(F.collect_set("table_name")).alias("among"))
        .filter("found IS NULL")
    )
    out = out.unionByName(_finding(lost, "SCHEMA-COL-001", F.format_string("Column '%s' is in none of the tables read: %s", "name", F.concat_ws(", ", "among")), F.col("name")))

    of = F.when(F.col("qualifier") != "", F.coalesce(F.col("aliases")[F.col("qualifier")], "qualifier")).when(F.size("tables") == 1, F.col("tables")[0])
    filtered = refs.filter("clause = 'where'").select("scope", "seq", of.alias("table_name"), "name", "key").filter("table_name IS NOT NULL")
    each = filtered.groupBy("scope", "seq", "table_name", "name").agg(F.max("key").alias("key"))
    bare_of_index = each.join(columns, ["scope", "table_name", "name"], "left_semi").join(indexed.unionByName(keys).distinct(), ["scope", "table_name", "name"], "left_anti")
    is_json = F.col("key").isNotNull()
    plain = F.format_string("Column '%s' in WHERE has no index on table '%s'", "name", "table_name")
    within = F.format_string("JSON column '%s' in WHERE has no index on table '%s'", "name", "table_name")
    make = F.format_string("CREATE INDEX idx_%s_%s ON %s(%s);", "table_name", "name", "table_name", "name")
    make_json = F.format_string("CREATE INDEX idx_%s_%s_gin ON %s USING GIN (%s);", "table_name", "name", "table_name", "name")
    return out.unionByName(
        _finding(bare_of_index, "SCHEMA-IDX-001", F.when(is_json, within).otherwise(plain), F.col("name"), F.format_string("Index %s(%s)", "table_name", "name"), F.when(is_json, make_json).otherwise(make))
    )


def migration_findings(events: DataFrame, objects: DataFrame) -> DataFrame:
    """MIG-BRK-001 for each drop of a table or column that an earlier statement of the chain made."""
    broken = breaking_changes(events, objects)
    said = F.when(F.col("kind") == "table", F.format_string("Dropping table '%s' breaks what reads it", "name")).otherwise(F.format_string("Dropping column '%s.%s' breaks what reads it", "table_name", "name"))
    return _finding(broken, "MIG-BRK-001", said, F.col("name"))


def break_findings(read: DataFrame, events: DataFrame) -> DataFrame:
    """SCH-BRK-001 for each drop of a table or column that other statements of the scope use."""
    drops = events.filter("action = 'drop' AND kind IN ('table', 'column')").select("scope", F.col("seq").alias("key"), "table_name", F.when(F.col("kind") == "column", F.col("name")).alias("column_name"))
    used = read.select("scope", F.col("seq").alias("key"), F.explode("tables").alias("table_name"), F.transform("refs", lambda r: r["name"]).alias("columns"))
    found = cross_file_breaks(drops, used).withColumnRenamed("key", "seq")
    what = F.concat_ws(".", "table_name", "column_name")
    return _finding(found, "SCH-BRK-001", F.format_string("Dropping '%s' breaks %d other statements", what, "n_uses"), what)


def project_findings(statements: DataFrame, scope: str, seq: str, text: str = "raw", migrations: bool = True) -> DataFrame:
    """scope, seq, rule_id, message, snippet, fix, replacement of all rules over several statements.

    `seq` numbers the statements of a scope in their order (a migration chain's, or the project's).
    Null texts have no findings; an empty table gives an empty result; further columns are ignored.
    """
    chosen = statements.select(F.col(scope).cast("string").alias("scope"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("raw"))
    events = ddl_events(chosen, "scope", "seq")
    objects = history(events)
    read = uses(chosen)
    current = objects.filter("valid_to IS NULL")
    out = schema_findings(read, current).unionByName(break_findings(read, events))
    if migrations:
        out = out.unionByName(migration_findings(events, objects))
    keyed = chosen.withColumn("at", F.struct("scope", "seq"))

    def back(df: DataFrame, rule_id: str, message: Column, snippet: Column) -> DataFrame:
        return _finding(df.withColumns({"scope": F.col("at.scope"), "seq": F.col("at.seq")}), rule_id, message, snippet)

    idle = unused_objects(keyed, ["scope"], "at")
    out = out.unionByName(back(idle, "QUAL-DEAD-001", F.format_string("%s '%s' is used nowhere", F.initcap("object_kind"), F.lower("name")), F.lower("name")))
    out = out.unionByName(back(unreachable_code(keyed, "at"), "QUAL-DEAD-002", F.lit("Code behind RETURN never runs"), F.col("snippet")))
    twice = duplicates(keyed, ["seq"], "at", ("scope",))
    out = out.unionByName(back(twice, "QUAL-DEAD-003", F.format_string("The same statement occurs %d times", "n_copies"), F.lit(None).cast("string")))
    return out.withColumn("scope", F.col("scope").cast(statements.schema[scope].dataType))
