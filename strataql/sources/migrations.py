"""Migration projects of five frameworks as ordered scripts.

Files come in as sources (file, content); each is recognised by its path and content. SQL scripts
are taken as they are; Python migrations come as their operations' events, with DDL for the rules
that read text. A project's scripts are numbered: by version, as a number where the framework
counts, by the chain of revisions where it links them, else as text.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataql.operators.hierarchy import hierarchy
from strataql.operators.schema import EVENT, ddl_events
from strataql.operators.schema import _FIELDS as FIELDS
from strataql.operators.splitting import split_sources
from strataql.sources.operations import Step, literal, literals, model_steps, upgrade_steps

# How the frameworks' files look.
NUMBERED = re.compile(r"^V(\d+)__.*\.sql$")
CHANGESET = re.compile(r"--changeset\s+[\w.-]+:([\w.-]+)[^\n]*\n(.*?)(?=\n--changeset|\Z)", re.DOTALL)
HEADER = "--liquibase formatted sql"

#: framework, project, version, revisions it follows, steps.
Script = tuple[str, str, str, list[str], list[Step]]


def _assigned(body: list[ast.stmt]) -> dict[str, ast.AST]:
    plain = {t.id: n.value for n in body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
    return plain | {n.target.id: n.value for n in body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and n.value}


def _python_script(folder: str, stem: str, content: str) -> list[Script]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    named = _assigned(tree.body)
    if "revision" in named:
        steps = [s for f in tree.body if isinstance(f, ast.FunctionDef) and f.name == "upgrade" for s in upgrade_steps(f.body)]
        down = named.get("down_revision")
        return [("alembic", folder, literal(named["revision"]), literals(down) or [x for x in [literal(down)] if x], steps)]
    for node in tree.body:
        if isinstance(node, ast.ClassDef) and node.name == "Migration":
            inner = _assigned(node.body)
            follows = [literal(d.elts[1]) for d in getattr(inner.get("dependencies"), "elts", []) if isinstance(d, ast.Tuple) and len(d.elts) > 1]
            return [("django", folder, stem, follows, list(model_steps(inner.get("operations"))))]
    return []


def scripts(file: str, content: str) -> list[Script]:
    """The migration scripts in a file; none for other files."""
    folder, name = posixpath.split(file)
    stem, suffix = posixpath.splitext(name)
    if suffix == ".py":
        return _python_script(folder, stem, content) if stem != "__init__" else []
    if suffix != ".sql":
        return []
    if HEADER in content.lower():
        return [("liquibase", folder, f"{stem}_{k}_{m[1]}", [], [(m[2].strip(), [])]) for k, m in enumerate(CHANGESET.finditer(content))]
    numbered = NUMBERED.match(name)
    if numbered:
        return [("flyway", folder, numbered[1], [], [(content, [])])]
    if name == "migration.sql":
        project, version = posixpath.split(folder)
        return [("prisma", project, version, [], [(content, [])])]
    return []


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (file, framework, project, version, "\n".join(sql for sql, _ in steps), follows, [{"sql": sql, "events": events} for sql, events in steps])
            for file, content in zip(pdf["file"], pdf["content"])
            if content
            for framework, project, version, follows, steps in scripts(file, content)
        ]
        yield pd.DataFrame(rows, columns=["file", "framework", "project", "version", "content", "depends_on", "steps"])


_STEP = "struct<sql:string,events:array<struct<" + ",".join(p.replace(" ", ":", 1) for p in EVENT.split(", ")) + ">>>"


def migrations(sources: DataFrame) -> DataFrame:
    """file, framework, project, version, content, depends_on, steps, seq of every migration script.

    seq counts from 1 within a project: by number for flyway; by the chain of revisions, then as
    text, for alembic; else by version as text. Null and empty contents and files of no framework
    are left out; an empty table gives an empty result.
    """
    found = sources.select("file", "content").mapInPandas(_read, f"file string, framework string, project string, version string, content string, depends_on array<string>, steps array<{_STEP}>")
    chained = found.filter("framework = 'alembic'")
    depth = hierarchy(chained.select("project", "version", "depends_on"), "project", "version", "depends_on", lists=False)
    place = depth.select(F.lit("alembic").alias("framework"), F.col("scope").alias("project"), F.col("node").alias("version"), "depth")
    number = F.when(F.col("framework") == "flyway", F.col("version").cast("decimal(38,0)"))
    by_version = Window.partitionBy("framework", "project").orderBy(number, "depth", "version", "file")
    return found.join(place, ["framework", "project", "version"], "left").withColumn("seq", F.row_number().over(by_version)).select("file", "framework", "project", "version", "content", "depends_on", "steps", "seq")


#: Statements that a script of a chain may have.
STATEMENTS = 1_000_000


def statements_of(found: DataFrame) -> DataFrame:
    """file, scope (framework and project), seq (over the whole chain), raw, events (null for SQL) of every statement of the scripts."""
    scope = F.concat_ws("/", "framework", "project")
    each = found.select("file", scope.alias("scope"), "seq", F.posexplode("steps").alias("k", "step"))
    given = each.filter(F.size("step.events") > 0).select("file", "scope", (F.col("seq").cast("long") * STATEMENTS + F.col("k") * 1000).alias("seq"), F.col("step.sql").alias("raw"), F.col("step.events").alias("events"))
    texts = each.filter(F.size("step.events") == 0).select(F.to_json(F.struct("file", "scope", "seq", "k")).alias("file"), F.col("step.sql").alias("content"))
    parts = split_sources(texts).select(F.from_json("file", "file string, scope string, seq long, k int").alias("at"), "query_index", "raw")
    read = parts.select("at.file", "at.scope", (F.col("at.seq") * STATEMENTS + F.col("at.k") * 1000 + F.col("query_index")).alias("seq"), "raw", F.lit(None).cast(given.schema["events"].dataType).alias("events"))
    return given.unionByName(read)


def migration_events(statements: DataFrame) -> DataFrame:
    """scope, seq, step and the fields of every schema event of statements_of's rows."""
    given = statements.filter("events IS NOT NULL").select("scope", "seq", F.posexplode("events").alias("step", "e")).select("scope", "seq", "step", *[f"e.{f}" for f in FIELDS])
    return given.unionByName(ddl_events(statements.filter("events IS NULL"), "scope", "seq").select("scope", "seq", "step", *FIELDS))
