"""Operators on small authored inputs, with the results worked out by hand as SQL literals.

They show what no table at hand holds: scripts, application code, mappers, migrations, DDL
histories, suppressions, fixes and rules of one's own. The queries don't read the folder's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.functions.registry import RuleRegistry
from strataql.operators import filters, fixes, schema, splitting
from strataql.operators.findings import prepare
from strataql.operators.schema_rules import project_findings
from strataql.rules.catalog import load_rules
from strataql.sources import extract, migrations

SCRIPT = """-- first
SELECT a; -- no ; here
  UPDATE t SET b = 'x;y' /* ; */ WHERE c = 1;
BEGIN SELECT 1; SELECT CASE WHEN a THEN 1 END; END;
CREATE FUNCTION f() AS $x$ SELECT 2; $x$;
SELECT * FROM {{ ref('t') }}{% if a %} WHERE b{% endif %} LIMIT 3"""
SPLIT = [
    (0, "SELECT a;", 2, 1),
    (1, "UPDATE t SET b = 'x;y' /* ; */ WHERE c = 1;", 3, 3),
    (2, "BEGIN SELECT 1; SELECT CASE WHEN a THEN 1 END; END;", 4, 1),
    (3, "CREATE FUNCTION f() AS $x$ SELECT 2; $x$;", 5, 1),
    (4, "SELECT * FROM {{ ref('t') }}{% if a %} WHERE b{% endif %} LIMIT 3", 6, 1),
]


def example_split(spark: SparkSession, folder: str) -> DataFrame:
    """A script's statements with quotes, comments, blocks, dollar quotes and templates."""
    return splitting.split_sources(spark.createDataFrame([("a.sql", SCRIPT)], "file string, content string")).select("query_index", "raw", "line_no", "col_no")


CODE = [
    ("a.py", "python", 'x = 1\ndb.run("SELECT a FROM t")\ndb.run(f"DELETE FROM t WHERE id = {x}")\nprint("hello")\n'),
    ("a.ts", "typescript", "const q = `SELECT a\nFROM t WHERE b = ${id}`;\nconst s = 'plain';\n"),
    ("A.java", "java", 'String q = "UPDATE t SET a = 1";\n'),
    ("a.go", "go", 'q := fmt.Sprintf("SELECT a FROM t WHERE b = %d", x)\n'),
    ("a.rb", "ruby", 'q = "INSERT INTO t VALUES (#{x})"\n'),
    ("m.xml", "mapper", '<mapper>\n<select id="one">SELECT a FROM t <where><if test="x">AND b = #{b}</if></where></select>\n<delete id="two">DELETE FROM ${name}</delete>\n</mapper>'),
]
EXTRACTED = [
    ("A.java", 0, "UPDATE t SET a = 1", 1, False),
    ("a.go", 0, "SELECT a FROM t WHERE b = %d", 1, True),
    ("a.py", 0, "SELECT a FROM t", 2, False),
    ("a.py", 1, "DELETE FROM t WHERE id = __dynamic__", 3, True),
    ("a.rb", 0, "INSERT INTO t VALUES (#{x})", 1, True),
    ("a.ts", 0, "SELECT a\nFROM t WHERE b = ${id}", 1, True),
    ("m.xml", 0, "SELECT a FROM t WHERE b = ?", 2, True),
    ("m.xml", 1, "DELETE FROM __DYNAMIC__", 3, True),
]


def example_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Statements in application code and mappers."""
    sources = spark.createDataFrame([(f, r, c) for f, r, c in CODE], "file string, route string, content string")
    return extract.extract_sources(sources).select("file", "query_index", "raw", "line_no", "is_dynamic")


MIGRATIONS = [
    ("fly/V10__b.sql", "DROP TABLE t"),
    ("fly/V2__a.sql", "CREATE TABLE t (a INT)"),
    ("liq/c.sql", "--liquibase formatted sql\n--changeset bob:1\nCREATE TABLE a (x INT);\n--changeset bob:2\nDROP TABLE a;\n"),
    ("prj/m/2024_b/migration.sql", "DROP TABLE z"),
    ("prj/m/2023_a/migration.sql", "CREATE TABLE z (a INT)"),
    ("alb/1.py", "revision = 'k'\ndown_revision = 'z'\ndef upgrade():\n    op.drop_column('u', 'n')\n"),
    ("alb/2.py", "revision = 'z'\ndown_revision = None\ndef upgrade():\n    op.create_table('u', sa.Column('n', sa.Integer(), nullable=False))\n"),
    ("dj/0001_x.py", "class Migration(m.Migration):\n    operations = [m.CreateModel('Item', [('n', models.TextField())]), m.RenameField('Item', 'n', 'k')]\n"),
    ("readme.md", "nothing"),
]
ORDERED = [
    ("alembic", "alb", 1, "z", "CREATE TABLE u (n INTEGER NOT NULL);"),
    ("alembic", "alb", 2, "k", "ALTER TABLE u DROP COLUMN n;"),
    ("django", "dj", 1, "0001_x", "CREATE TABLE item (n TEXT NOT NULL);\nALTER TABLE item RENAME COLUMN n TO k;"),
    ("flyway", "fly", 1, "2", "CREATE TABLE t (a INT)"),
    ("flyway", "fly", 2, "10", "DROP TABLE t"),
    ("liquibase", "liq", 1, "c_0_1", "CREATE TABLE a (x INT);"),
    ("liquibase", "liq", 2, "c_1_2", "DROP TABLE a;"),
    ("prisma", "prj/m", 1, "2023_a", "CREATE TABLE z (a INT)"),
    ("prisma", "prj/m", 2, "2024_b", "DROP TABLE z"),
]
BROKEN = [("alembic/alb", "column", "n"), ("django/dj", "column", "n"), ("flyway/fly", "table", "t"), ("liquibase/liq", "table", "a"), ("prisma/prj/m", "table", "z")]


def _chains(spark: SparkSession) -> DataFrame:
    return migrations.migrations(spark.createDataFrame(MIGRATIONS, "file string, content string"))


def example_migrations(spark: SparkSession, folder: str) -> DataFrame:
    """Migration scripts of five frameworks, in their order."""
    return _chains(spark).select("framework", "project", "seq", "version", "content")


def example_breaking_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Drops and renames, along each chain, of what an earlier script made."""
    events = migrations.migration_events(migrations.statements_of(_chains(spark)))
    return schema.breaking_changes(events, schema.history(events)).select("scope", "kind", "name")


DDL = [
    (1, "CREATE TABLE users (id SERIAL PRIMARY KEY, email VARCHAR(255) NOT NULL UNIQUE, made TIMESTAMPTZ, boss INT REFERENCES staff(no))"),
    (2, "CREATE TABLE app.orders (id INT, user_id INTEGER NOT NULL, total DECIMAL(10, 2), PRIMARY KEY (id), FOREIGN KEY (user_id) REFERENCES users(id))"),
    (3, "CREATE INDEX ix ON users (email)"),
    (4, "CREATE VIEW v AS SELECT id FROM users"),
    (5, "ALTER TABLE users ADD COLUMN age INT, DROP COLUMN made"),
    (6, "DROP TABLE orders"),
    (7, "CREATE TABLE orders (id BIGINT)"),
]
NOW = [
    ("column", "orders", "id", "BIGINT", True, None),
    ("column", "users", "age", "INTEGER", True, None),
    ("column", "users", "boss", "INTEGER", True, "staff.no"),
    ("column", "users", "email", "VARCHAR", False, None),
    ("column", "users", "id", "INTEGER", False, None),
    ("index", "users", "ix", None, None, None),
    ("table", "orders", "orders", None, None, None),
    ("table", "users", "users", None, None, None),
    ("view", "v", "v", None, None, None),
]
BEFORE_5 = [("column", "orders", "id"), ("column", "orders", "total"), ("column", "orders", "user_id"), ("column", "users", "boss"), ("column", "users", "email"), ("column", "users", "id"), ("column", "users", "made"), ("index", "users", "ix"), ("table", "orders", "orders"), ("table", "users", "users"), ("view", "v", "v")]


def _objects(spark: SparkSession) -> DataFrame:
    return schema.history(schema.ddl_events(spark.createDataFrame([("p", s, t) for s, t in DDL], "scope string, seq long, raw string"), "scope", "seq"))


def example_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The schema that a DDL history leaves."""
    return schema.current(_objects(spark)).select("kind", "table_name", "name", "type", "nullable", "foreign_key")


def example_schema_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The schema that statement 5 of the history sees."""
    return schema.as_of(_objects(spark), 5).select("kind", "table_name", "name")


PROJECT = [
    *DDL[:3],
    (10, "SELECT email FROM users WHERE age2 = 1"),
    (11, "SELECT u.id FROM users u WHERE u.id = 1 AND u.boss = 2"),
    (12, "SELECT x FROM ghosts"),
    (13, "SELECT total FROM orders WHERE id = 3"),
    (14, "SELECT total FROM orders WHERE id = 4"),
    (15, "ALTER TABLE orders DROP COLUMN total"),
    (16, "CREATE VIEW lonely AS SELECT 1"),
    (17, "CREATE PROCEDURE p() BEGIN SELECT 1; RETURN 1; SELECT 2; END"),
]
FOUND = [
    (10, "SCHEMA-COL-001", "age2"),
    (11, "SCHEMA-IDX-001", "boss"),
    (12, "SCHEMA-TBL-001", "ghosts"),
    (13, "SCHEMA-COL-001", "total"),
    (14, "QUAL-DEAD-003", None),
    (14, "SCHEMA-COL-001", "total"),
    (15, "MIG-BRK-001", "total"),
    (15, "SCH-BRK-001", "orders.total"),
    (16, "QUAL-DEAD-001", "lonely"),
    (17, "QUAL-DEAD-001", "p"),
    (17, "QUAL-DEAD-002", "SELECT 2;"),
]


def example_project(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the rules over several statements of a project."""
    statements = spark.createDataFrame([("p", s, t) for s, t in PROJECT], "scope string, seq long, raw string")
    return project_findings(statements, "scope", "seq").select("seq", "rule_id", "snippet")


TEXT = "SELECT a, 'x''y' FROM t -- note\nWHERE b >= 1.5"
TOKENS = [
    (0, "SELECT", "KEYWORD", 0), (2, "a", "IDENTIFIER", 7), (3, ",", "PUNCTUATION", 8), (5, "'x''y'", "STRING", 10), (7, "FROM", "KEYWORD", 17), (9, "t", "IDENTIFIER", 22),
    (13, "WHERE", "KEYWORD", 32), (15, "b", "IDENTIFIER", 38), (17, ">=", "OPERATOR", 40), (19, "1.5", "NUMBER", 43),
]


def example_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A statement's tokens that count, with their places."""
    found = splitting.tokens(spark.createDataFrame([(1, TEXT)], "stmt_id long, raw string"), "stmt_id")
    return splitting.significant(found).select("position", "token", "type", "start_offset")


LOCATIONS = [(0, 1, 1), (9, 1, 10), (31, 1, 32), (32, 2, 1), (38, 2, 7)]


def example_locations(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and columns of offsets of a text."""
    at = spark.createDataFrame([(TEXT, o) for o, _, _ in LOCATIONS], "text string, at int")
    return at.select("at", splitting.location(F.col("text"), F.col("at")).alias("l")).select("at", "l.line", "l.column")


P = filters.DIRECTIVE_PREFIX
SUPPRESSED = f"-- {P}-disable PERF\nSELECT 1;\n-- {P}-enable PERF\nSELECT 2; -- {P}-disable-line SEC-AUTH-001\n-- {P}-disable-next-line\nSELECT 3;\nSELECT '-- {P}-disable-file';\n"
DIRECTIVES = [("block", 2, 2, "PERF"), ("line", 4, 4, "SEC-AUTH-001"), ("line", 6, 6, None)]


def example_suppressions(spark: SparkSession, folder: str) -> DataFrame:
    """A script's suppressions; one within quotes is none."""
    found = filters.directives(spark.createDataFrame([("a.sql", SUPPRESSED)], "file string, content string"))
    return found.select("scope", "start_line", "end_line", "rule_prefix")


REWRITTEN = [
    ("PERF-LOCK-002", "SELECT a FROM t WITH (NOLOCK)", "SELECT a FROM t"),
    ("QUAL-DUCK-001", "SELECT DATE(x) FROM t", "SELECT CAST(x AS DATE) FROM t"),
    ("QUAL-MODERN-004", "SELECT CASE WHEN a THEN 1 END", "SELECT CASE WHEN a THEN 1 ELSE NULL END"),
    ("QUAL-MYSQL-001", "SELECT SQL_CALC_FOUND_ROWS a FROM t", "SELECT a FROM t"),
    ("QUAL-MYSQL-003", "SELECT a FROM t LOCK IN SHARE MODE", "SELECT a FROM t FOR SHARE"),
    ("QUAL-NULL-001", "SELECT a FROM t WHERE b <> NULL", "SELECT a FROM t WHERE b IS NOT NULL"),
    ("QUAL-ORA-002", "SELECT 1 FROM DUAL", "SELECT 1"),
    ("QUAL-PG-001", "DO $$ x $$", "DO $$ x $$ LANGUAGE plpgsql;"),
    ("QUAL-PG-002", "SELECT doc   ->  'x' FROM t", "SELECT doc -> 'x' FROM t"),
    ("QUAL-STYLE-002", "SELECT a WHERE EXISTS (SELECT * FROM u)", "SELECT a WHERE EXISTS (SELECT 1 FROM u)"),
    ("QUAL-TSQL-001", "SET ANSI_NULLS OFF", "SET ANSI_NULLS ON"),
    ("QUAL-TSQL-002", "SET QUOTED_IDENTIFIER OFF", "SET QUOTED_IDENTIFIER ON"),
]


def example_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """Every safe rewrite on a text of its own."""
    texts = spark.createDataFrame([(r, t) for r, t, _ in REWRITTEN], "rule_id string, raw string")
    out = F.lit(None).cast("string")
    for rule_id in fixes.SAFE_REWRITES:
        out = F.when(F.col("rule_id") == rule_id, fixes.rewrite(F.col("raw"), rule_id)).otherwise(out)
    return texts.select("rule_id", out.alias("fixed"))


OWN = '{"rules": [{"id": "OWN-1", "pattern": "drop\\\\s+database", "severity": "HIGH", "dialects": ["mysql"]}]}'
OWN_TEXTS = [(1, "DROP  DATABASE x", "mysql"), (2, "DROP DATABASE x", "oracle"), (3, "SELECT 1", "mysql"), (4, "SELECT a FROM b WHERE c = 1", None)]
OWN_FOUND = [(1, "OWN-1", "DROP  DATABASE"), (3, "OWN-2", "SELECT 1"), (4, "OWN-3", "b")]


def example_own_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of one's own: a pattern with dialects, a Column condition, a Python function."""
    own = RuleRegistry()
    for rule in load_rules(OWN):
        own.add(rule.rule_id, rule)
    own.add("OWN-2", lambda: ~F.col("raw_upper").contains("FROM") & F.col("raw_upper").startswith("SELECT"))
    own.add("OWN-3", lambda text: [w for w in text.split() if w == "b"], as_text=True)
    ready = prepare(spark.createDataFrame(OWN_TEXTS, "stmt_id long, raw string, dialect string"))
    return own.findings(ready, "stmt_id")


def _values(columns: dict[str, str], rows: list[tuple]) -> str:
    """SELECT of literal rows."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        return str(value).upper() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    casts = ", ".join(f'"{c}"::{kind} AS "{c}"' for c, kind in columns.items())
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(f'"{c}"' for c in columns)})"


_I, _S, _B = "INT", "VARCHAR", "BOOLEAN"
_EXAMPLES: list[tuple[Callable[[SparkSession, str], DataFrame], dict[str, str], list[tuple]]] = [
    (example_split, {"query_index": _I, "raw": _S, "line_no": _I, "col_no": _I}, SPLIT),
    (example_extract, {"file": _S, "query_index": _I, "raw": _S, "line_no": _I, "is_dynamic": _B}, EXTRACTED),
    (example_migrations, {"framework": _S, "project": _S, "seq": _I, "version": _S, "content": _S}, ORDERED),
    (example_breaking_changes, {"scope": _S, "kind": _S, "name": _S}, BROKEN),
    (example_schema, {"kind": _S, "table_name": _S, "name": _S, "type": _S, "nullable": _B, "foreign_key": _S}, NOW),
    (example_schema_as_of, {"kind": _S, "table_name": _S, "name": _S}, BEFORE_5),
    (example_project, {"seq": "BIGINT", "rule_id": _S, "snippet": _S}, FOUND),
    (example_tokens, {"position": _I, "token": _S, "type": _S, "start_offset": "BIGINT"}, TOKENS),
    (example_locations, {"at": _I, "line": _I, "column": _I}, LOCATIONS),
    (example_suppressions, {"scope": _S, "start_line": _I, "end_line": _I, "rule_prefix": _S}, DIRECTIVES),
    (example_rewrites, {"rule_id": _S, "fixed": _S}, [(r, t) for r, _, t in REWRITTEN]),
    (example_own_rules, {"stmt_id": "BIGINT", "rule_id": _S, "snippet": _S}, OWN_FOUND),
]

QUERIES = {f.__name__: f for f, _, _ in _EXAMPLES}
SQL = {f.__name__: _values(columns, rows) for f, columns, rows in _EXAMPLES}
