"""Schemas from DDL as an ordered stream of events, their history, and the rules that need them.

Every DDL statement becomes events (table created or dropped, column added or dropped, index, view,
procedure). The schema before position p is the last event of each object before p; an object's
validity is the range between its events, so asking for a past schema is a range condition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataql.operators.structure import bare, words

# Column types by their SQL spelling.
TYPES = {
    "INT": "INTEGER", "INTEGER": "INTEGER", "SERIAL": "INTEGER", "BIGSERIAL": "INTEGER", "BIGINT": "BIGINT", "SMALLINT": "SMALLINT", "VARCHAR": "VARCHAR", "CHARACTER VARYING": "VARCHAR",
    "TEXT": "TEXT", "CHAR": "CHAR", "CHARACTER": "CHAR", "DECIMAL": "DECIMAL", "NUMERIC": "DECIMAL", "FLOAT": "FLOAT", "REAL": "FLOAT", "DOUBLE": "DOUBLE", "DOUBLE PRECISION": "DOUBLE",
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "TIMESTAMP": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP", "DATE": "DATE", "TIME": "TIME", "TIMETZ": "TIME", "JSON": "JSON", "JSONB": "JSONB", "ARRAY": "ARRAY",
}

EVENT = "kind string, action string, table_name string, name string, type string, nullable boolean, default_text string, primary_key boolean, is_unique boolean, foreign_key string, columns array<string>, ordinal int"
_FIELDS = [p.split()[0] for p in EVENT.split(", ")]


def _event(kind: str, action: str, table: str, name: str = "", **more) -> dict:
    return {"kind": kind, "action": action, "table_name": table, "name": name, "type": None, "nullable": None, "default_text": None, "primary_key": None, "is_unique": None, "foreign_key": None, "columns": None, "ordinal": 0} | more


def _name(w: list[str], k: int) -> tuple[str, int]:
    """A dotted name's last part and the position behind it."""
    while k + 2 < len(w) and w[k + 1] == ".":
        k += 2
    return (bare(w[k]), k + 1) if k < len(w) else ("", k)


def _items(w: list[str], k: int) -> tuple[list[list[str]], int]:
    """Comma-separated items of the bracket that opens at k, and the position behind it."""
    items, depth, now = [], 0, []
    for j in range(k, len(w)):
        depth += (w[j] == "(") - (w[j] == ")")
        if depth == 0:
            return items + ([now] if now else []), j + 1
        if w[j] == "," and depth == 1:
            items.append(now)
            now = []
        elif j > k:
            now.append(w[j])
    return items + ([now] if now else []), len(w)


def _listed(item: list[str], after: int = 0) -> list[str]:
    if "(" not in item[after:]:
        return []
    return [bare(x) for x in item[item.index("(", after) + 1 :] if x not in (",", ")", "(")]


def column_type(item: list[str]) -> str:
    up = [x.upper() for x in item]
    if "[" in item or "ARRAY" in up[1:3]:
        return "ARRAY"
    two = " ".join(up[1:3])
    return TYPES.get(two) or (TYPES.get(up[1]) if len(up) > 1 else None) or "UNKNOWN"


def _column(table: str, item: list[str], ordinal: int) -> dict:
    up = [x.upper() for x in item]
    primary = "PRIMARY" in up
    target = None
    if "REFERENCES" in up:
        at = up.index("REFERENCES") + 1
        to, behind = _name(item, at)
        cols = _listed(item, at)
        target = f"{to}.{cols[0] if cols else 'id'}"
    default = item[up.index("DEFAULT") + 1] if "DEFAULT" in up[:-1] else None
    not_null = any(a == "NOT" and b == "NULL" for a, b in zip(up, up[1:]))
    return _event("column", "create", table, bare(item[0]), type=column_type(item), nullable=not (primary or not_null), default_text=default, primary_key=primary, is_unique="UNIQUE" in up, foreign_key=target, ordinal=ordinal)


def events(text: str) -> list[dict]:
    """The events of one DDL statement; none for other statements and for DDL that can't be read."""
    w = words(text)
    while w and w[-1] == ";":
        w.pop()
    up = [x.upper() for x in w]
    if not w or up[0] not in ("CREATE", "DROP", "ALTER"):
        return []
    k = 1
    while k < len(w) and up[k] in ("OR", "REPLACE", "TEMP", "TEMPORARY", "UNIQUE", "MATERIALIZED", "GLOBAL", "LOCAL"):
        k += 1
    if k >= len(w):
        return []
    what, unique = up[k], "UNIQUE" in up[1:k]
    k += 1
    while k < len(w) and up[k] in ("IF", "NOT", "EXISTS", "CONCURRENTLY", "ONLY"):
        k += 1
    if k >= len(w):
        return []
    name, after = _name(w, k)
    if up[0] == "DROP":
        return [_event(what.lower(), "drop", name, name)] if what in ("TABLE", "VIEW", "INDEX", "PROCEDURE", "FUNCTION") else []
    if up[0] == "ALTER":
        return _altered(w, up, name, after) if what == "TABLE" else []
    if what == "TABLE":
        return _created(w, name, after)
    if what == "INDEX" and "ON" in up[after - 1 :]:
        at = up.index("ON", after - 1) + 1
        table, behind = _name(w, at)
        while behind < len(w) and w[behind] != "(":
            behind += 1
        cols = [bare(i[0]) for i in _items(w, behind)[0] if i]
        return [_event("index", "create", table, name, columns=cols, is_unique=unique)]
    if what == "VIEW":
        reads = [_name(w, j + 1)[0] for j in range(after, len(w) - 1) if up[j] in ("FROM", "JOIN") and w[j + 1] != "("]
        return [_event("view", "create", name, name, columns=sorted(set(reads)))]
    if what in ("PROCEDURE", "FUNCTION", "PROC"):
        calls = [_name(w, j + 1)[0] for j in range(after, len(w) - 1) if up[j] in ("CALL", "EXEC", "EXECUTE")]
        return [_event("procedure", "create", name, name, columns=sorted(set(calls)))]
    return []


def _created(w: list[str], name: str, after: int) -> list[dict]:
    out = [_event("table", "create", name, name)]
    if after >= len(w) or w[after] != "(":
        return out
    columns: dict[str, dict] = {}
    for item in _items(w, after)[0]:
        up = [x.upper() for x in item]
        head = up[2:] if up[0] == "CONSTRAINT" else up
        at = len(up) - len(head)
        if not head:
            continue
        if head[0] in ("PRIMARY", "UNIQUE", "FOREIGN", "KEY", "INDEX", "CHECK") and not (head[0] in ("KEY", "INDEX") and "(" not in item):
            cols = [bare(x) for x in item[item.index("(") + 1 : item.index(")")] if x != ","] if "(" in item and ")" in item else []
            for c in cols:
                if c not in columns:
                    continue
                if head[0] == "PRIMARY":
                    columns[c] |= {"primary_key": True, "nullable": False}
                elif head[0] == "UNIQUE" and len(cols) == 1:
                    columns[c] |= {"is_unique": True}
                elif head[0] == "FOREIGN" and "REFERENCES" in up:
                    r = up.index("REFERENCES") + 1
                    to = _listed(item, r)
                    columns[c] |= {"foreign_key": f"{_name(item, r)[0]}.{to[0] if to else 'id'}"}
            if head[0] in ("KEY", "INDEX"):
                out.append(_event("index", "create", name, bare(item[at + 1]), columns=cols, is_unique=False))
        else:
            made = _column(name, item, len(columns) + 1)
            columns[made["name"]] = made
    return out + list(columns.values())


def _altered(w: list[str], up: list[str], table: str, after: int) -> list[dict]:
    """Each ADD or DROP of a column; further actions of the statement follow after commas."""
    rest, depth, actions = [], 0, []
    for t in w[after:]:
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            actions.append(rest)
            rest = []
        else:
            rest.append(t)
    out = []
    for action in [*actions, rest]:
        u = [x.upper() for x in action]
        k = 1
        while k < len(u) and u[k] in ("COLUMN", "IF", "NOT", "EXISTS"):
            k += 1
        if k >= len(u):
            continue
        if u[0] == "ADD" and u[k] not in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "INDEX", "KEY", "CHECK"):
            out.append(_column(table, action[k:], 1_000_000))
        elif u[0] == "DROP" and u[k] not in ("CONSTRAINT", "INDEX", "PRIMARY", "KEY", "FOREIGN"):
            out.append(_event("column", "drop", table, bare(action[k])))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for scope, seq, raw in zip(pdf["scope"], pdf["seq"], pdf["raw"]):
            for k, e in enumerate(events(raw) if raw else []):
                rows.append((scope, seq, k, *[e[f] for f in _FIELDS]))
        yield pd.DataFrame(rows, columns=["scope", "seq", "step", *_FIELDS])


def ddl_events(statements: DataFrame, scope: str, seq: str, text: str = "raw") -> DataFrame:
    """scope, seq, step and the event's fields, for every DDL statement.

    `scope` separates schemas (a repository or project), `seq` orders statements within it.
    """
    chosen = statements.select(F.col(scope).cast("string").alias("scope"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("raw")).filter(F.col("raw").rlike(r"(?i)\b(?:create|drop|alter)\b"))
    return chosen.mapInPandas(_scan, f"scope string, seq long, step int, {EVENT}")


def history(found: DataFrame) -> DataFrame:
    """Each created object with the range in which it is there: valid_from (exclusive) to valid_to (inclusive, null: still).

    A position p sees an object when valid_from < p and (valid_to is null or p <= valid_to), so the
    statement that drops an object still sees it. A table's columns and indexes end with the table,
    also where it is created anew; a second creation of the same object ends the first.
    """
    own = Window.partitionBy("scope", "kind", "table_name", "name").orderBy("seq", "step")
    objects = found.withColumn("next_seq", F.lead("seq").over(own)).filter("action = 'create'")
    # One window over a table's events tells when it is next created or dropped.
    later = Window.partitionBy("scope", "table_name").orderBy("seq", "step").rowsBetween(1, Window.unboundedFollowing)
    ends = found.filter("kind = 'table'").select("scope", "table_name", "seq", "step", F.lit(True).alias("ends"))
    parts = objects.filter(F.col("kind").isin("column", "index"))
    marked = parts.withColumn("ends", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    ended = marked.withColumn("table_end", F.min(F.when(F.col("ends"), F.col("seq"))).over(later)).filter("NOT ends").drop("ends")
    whole = ended.unionByName(objects.filter(~F.col("kind").isin("column", "index")), allowMissingColumns=True)
    return whole.withColumns({"valid_from": F.col("seq"), "valid_to": F.least("next_seq", "table_end")}).drop("next_seq", "table_end", "action", "step")


def as_of(objects: DataFrame, seq: int) -> DataFrame:
    """The schema that position `seq` sees."""
    return objects.filter((F.col("valid_from") < seq) & (F.col("valid_to").isNull() | (F.col("valid_to") >= seq)))


def current(objects: DataFrame) -> DataFrame:
    return objects.filter("valid_to IS NULL")


def breaking_changes(found: DataFrame, objects: DataFrame) -> DataFrame:
    """MIG-BRK-001: drops of tables and columns that were there before: scope, seq, kind, table_name, name.

    The table or column must have been created by an earlier statement of the scope.
    """
    drops = found.filter("action = 'drop' AND kind IN ('table', 'column')").select("scope", F.col("seq").alias("drop_seq"), "kind", "table_name", "name")
    there = objects.select("scope", "kind", "table_name", "name", "valid_from", "valid_to")
    return (
        drops.join(there, ["scope", "kind", "table_name", "name"])
        .filter("valid_from < drop_seq AND (valid_to IS NULL OR valid_to >= drop_seq)")
        .select("scope", F.col("drop_seq").alias("seq"), "kind", "table_name", "name")
        .distinct()
    )


def missing_tables(uses: DataFrame, tables: DataFrame) -> DataFrame:
    """SCHEMA-TBL-001: (scope, key, table_name) of referenced tables that the schema lacks."""
    known = tables.select("scope", F.lower("table_name").alias("table_name")).distinct()
    return uses.withColumn("table_name", F.lower("table_name")).join(known, ["scope", "table_name"], "left_anti").distinct()


