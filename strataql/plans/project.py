"""Text, schema and project queries over the statements and schema_views tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.functions.dialects import canonical_dialect, canonical_dialect_sql, detect_dialect, detect_dialect_sql
from strataql.functions.names import bare_name
from strataql.functions.registry import register
from strataql.operators import fixes, project, schema, splitting
from strataql.operators.structure import nodes, structured
from strataql.sources.tables import table


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "statements")


def dialects(spark: SparkSession, folder: str) -> DataFrame:
    """Statements by declared and by detected dialect."""
    st = _statements(spark, folder).filter("raw IS NOT NULL")
    return st.groupBy(canonical_dialect(F.col("dialect")).alias("declared"), detect_dialect(F.col("raw")).alias("detected")).agg(F.count("*").alias("n_statements"))


def statement_types(spark: SparkSession, folder: str) -> DataFrame:
    """Statements by type and whether it is DDL, read from the text."""
    kind = splitting.statement_type(F.col("raw"))
    return _statements(spark, folder).filter("raw IS NOT NULL").groupBy(kind.alias("kind"), splitting.is_ddl(kind).alias("ddl")).agg(F.count("*").alias("n_statements"))


def token_types(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens by type."""
    return splitting.tokens(_statements(spark, folder), "stmt_id").groupBy("type").agg(F.count("*").alias("n_tokens"), F.count_distinct("token").alias("n_distinct"))


def files_split(spark: SparkSession, folder: str) -> DataFrame:
    """Each statement's text split again as a script: statements, and the digest of the first of each."""
    src = _statements(spark, folder).select(F.col("stmt_id").cast("string").alias("file"), F.col("raw").alias("content"))
    return splitting.split_sources(src).groupBy("query_index").agg(F.count("*").alias("n_statements"), F.max("line_no").alias("last_line"))


def split_in_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The same through the table function, as SQL would use it."""
    register(spark)
    _statements(spark, folder).createOrReplaceTempView("strataql_statements")
    return spark.sql("SELECT s.query_index, count(*) AS n_statements FROM strataql_statements, LATERAL split_sql(raw) s GROUP BY s.query_index")


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Statements without a normalised text, given one: white space collapsed, as digests."""
    st = _statements(spark, folder).filter("normalized IS NULL AND raw IS NOT NULL")
    return st.select("stmt_id", F.sha2(F.trim(F.regexp_replace("raw", r"\s+", " ")), 256).alias("sha"))


def tables_used(spark: SparkSession, folder: str) -> DataFrame:
    """Tables by how many statements name them, from the structure scan."""
    found = nodes(structured(_statements(spark, folder), ["stmt_id"]), "stmt_id").select("stmt_id", F.explode("tables").alias("table_name"))
    return found.distinct().groupBy("table_name").agg(F.count("*").alias("n_statements"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return schema.ddl_events(_statements(spark, folder), "repo_id", "stmt_id")


def schema_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Each repository's tables and columns after all its statements."""
    now = schema.current(schema.history(_events(spark, folder)))
    return now.groupBy("scope", "kind").agg(F.count("*").alias("n_objects"), F.count_distinct("table_name").alias("n_tables"))


def schema_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns by type and whether they may be null, after all statements."""
    now = schema.current(schema.history(_events(spark, folder))).filter("kind = 'column'")
    return now.groupBy("type", "nullable").agg(F.count("*").alias("n_columns"))


def breaking_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Drops of what an earlier statement of the repository created."""
    found = _events(spark, folder)
    return schema.breaking_changes(found, schema.history(found))


def missing_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that statements use but no DDL of their repository creates, by repository."""
    tables = schema.current(schema.history(_events(spark, folder))).filter("kind = 'table'")
    uses = _statements(spark, folder).filter("table_names IS NOT NULL").select(F.col("repo_id").cast("string").alias("scope"), F.col("stmt_id").alias("key"), F.explode("table_names").alias("table_name")).filter("table_name IS NOT NULL")
    return schema.missing_tables(uses, tables).groupBy("scope").agg(F.count("*").alias("n_missing"))


def unused_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects that a repository defines and never uses."""
    return project.unused_objects(_statements(spark, folder), ["repo_id"]).groupBy("repo_id", "object_kind").agg(F.count("*").alias("n_unused"))


def unused_views(spark: SparkSession, folder: str) -> DataFrame:
    """Views that no other view of their repository depends on."""
    v = table(spark, folder, "schema_views").filter("name IS NOT NULL").select("repo_id", bare_name(F.col("name")).alias("name"), F.transform("dependencies", bare_name).alias("deps"))
    used = v.select("repo_id", F.col("name").alias("by"), F.explode("deps").alias("name")).filter("by <> name").select("repo_id", "name").distinct()
    return v.select("repo_id", "name").filter("name <> ''").distinct().join(used, ["repo_id", "name"], "left_anti")


def duplicate_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Statements whose text, literals masked, an earlier one has."""
    return project.duplicates(_statements(spark, folder), ["file", "query_index", "stmt_id"])


def unreachable_code(spark: SparkSession, folder: str) -> DataFrame:
    """Code behind a RETURN."""
    return project.unreachable_code(_statements(spark, folder))


def cross_file_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Dropped tables and columns that other statements of the repository use."""
    drops = _events(spark, folder).filter("action = 'drop' AND kind IN ('table', 'column')").select("scope", F.col("seq").alias("key"), "table_name", F.when(F.col("kind") == "column", F.col("name")).alias("column_name"))
    st = _statements(spark, folder).filter("table_names IS NOT NULL")
    uses = st.select(F.col("repo_id").cast("string").alias("scope"), F.col("stmt_id").alias("key"), F.explode(F.array_distinct("table_names")).alias("table_name"), F.coalesce("column_names", F.array().cast("array<string>")).alias("columns"))
    return project.cross_file_breaks(drops, uses)


def rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """Statements that each safe rewrite changes."""
    st = _statements(spark, folder).filter("raw IS NOT NULL")
    changed = [F.when(fixes.rewrite(F.col("raw"), r) != F.col("raw"), F.lit(r)) for r in fixes.SAFE_REWRITES]
    return st.select(F.explode(F.array_compact(F.array(*changed))).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n_statements"))


def fixed_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Statements after their safe fixes, as digests."""
    found = table(spark, folder, "issues").filter("fix.is_safe AND stmt_id IS NOT NULL AND snippet IS NOT NULL")
    each = found.select("stmt_id", "rule_id", F.col("fix.description").alias("description"), F.col("snippet").alias("original"), F.col("fix.replacement").alias("replacement"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return fixes.apply_fixes(_statements(spark, folder), each).select("stmt_id", F.sha2("fixed", 256).alias("fixed_sha"), (F.length("diff") > 0).alias("changed"))


def fix_report(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes by confidence."""
    return fixes.fix_report(table(spark, folder, "issues").filter("fix IS NOT NULL").select("fix.*"))


QUERIES = {
    f.__name__: f
    for f in (
        dialects, statement_types, token_types, files_split, split_in_sql, normalized, tables_used, schema_tables, schema_columns, breaking_changes, missing_tables, unused_objects,
        unused_views, duplicate_queries, unreachable_code, cross_file_breaks, rewrites, fixed_statements, fix_report,
    )
}

_MASKED = r"trim(regexp_replace(regexp_replace(regexp_replace(raw, '''(?:[^'']|'''')*''', '?', 'g'), '\b\d+(?:\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g'))"
_DEF = project.DEFINITION.removeprefix("(?i)")
_BARE = r"""lower(trim(regexp_replace(regexp_extract(trim({0}, e' \t\r\n'), '("[^"]*"|`[^`]*`|\[[^\]]*\]|[^."`\[\]]+)\s*$', 1), '^["`\[]|["`\]]$', '', 'g'), e' \t\r\n'))"""

#: Objects of CREATE TABLE and CREATE FUNCTION: plain lists of columns, as the statements table has them.
_TYPE = "CASE " + " ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in schema.TYPES.items() if " " not in a) + " ELSE 'UNKNOWN' END"
_OBJECTS = rf"""made AS (
  SELECT repo_id::VARCHAR AS scope, stmt_id, regexp_extract(raw, '^(?:\s|--[^\n]*\n|/\*[\s\S]*?\*/)*create\s+table\s+["`\[]?(\w+)["`\]]?\s*\(([\s\S]*)\)', ['t', 'body'], 'i') AS m FROM statements WHERE raw IS NOT NULL),
tables AS (SELECT scope, stmt_id, m.t AS t, m.body AS body FROM made WHERE m.t <> ''),
last_made AS (SELECT * FROM tables QUALIFY row_number() OVER (PARTITION BY scope, t ORDER BY stmt_id DESC) = 1),
items AS (SELECT scope, t, trim(unnest(string_split(regexp_replace(body, '\([^)]*\)', '', 'g'), ',')), e' \t\r\n') AS item FROM last_made),
cols AS (SELECT DISTINCT scope, t, trim(regexp_extract(item, '^(\S+)', 1), '"`[]') AS name, upper(regexp_extract(item, '^\S+\s+(\w+)', 1)) AS word, NOT regexp_matches(item, 'not\s+null', 'i') AS nullable FROM items),
routines AS (SELECT DISTINCT repo_id::VARCHAR AS scope, regexp_extract(raw, '^(?:\s|--[^\n]*\n|/\*[\s\S]*?\*/)*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(\w+)', 1, 'i') AS t FROM statements WHERE raw IS NOT NULL)"""

SQL = {
    "schema_tables": f"""WITH {_OBJECTS}, o AS (
  SELECT scope, 'table' AS kind, t, t AS name FROM last_made UNION ALL SELECT scope, 'column', t, name FROM cols UNION ALL SELECT scope, 'procedure', t, t FROM routines WHERE t <> '')
SELECT scope, kind, count(*) AS n_objects, count(DISTINCT t) AS n_tables FROM o GROUP BY ALL""",
    "schema_columns": f"WITH {_OBJECTS} SELECT {_TYPE} AS type, nullable, count(*) AS n_columns FROM cols GROUP BY ALL",
    "missing_tables": f"""WITH {_OBJECTS}, u AS (SELECT DISTINCT repo_id::VARCHAR AS scope, stmt_id, lower(t) AS t FROM (SELECT repo_id, stmt_id, unnest(table_names) AS t FROM statements) WHERE t IS NOT NULL)
SELECT scope, count(*) AS n_missing FROM u WHERE NOT EXISTS (SELECT 1 FROM last_made l WHERE l.scope = u.scope AND lower(l.t) = u.t) GROUP BY 1""",
    "dialects": f"SELECT {canonical_dialect_sql('dialect')} AS declared, {detect_dialect_sql('raw')} AS detected, count(*) AS n_statements FROM statements WHERE raw IS NOT NULL GROUP BY ALL",
    "statement_types": r"""WITH w AS (SELECT upper(regexp_extract(raw, '^(?:\s|--[^\n]*\n|/\*[\s\S]*?\*/)*([A-Za-z]+)', 1)) AS word FROM statements WHERE raw IS NOT NULL),
k AS (SELECT CASE WHEN word = 'WITH' THEN 'SELECT' WHEN word = '' THEN NULL ELSE word END AS kind FROM w) SELECT kind, coalesce(kind IN ('CREATE', 'ALTER', 'DROP', 'TRUNCATE'), FALSE) AS ddl, count(*) AS n_statements FROM k GROUP BY ALL""",
    "token_types": f"WITH {splitting.tokens_sql()} SELECT type, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM typed GROUP BY type",
    "normalized": r"SELECT stmt_id, sha256(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS sha FROM statements WHERE normalized IS NULL AND raw IS NOT NULL",
    "unused_objects": f"""WITH d AS (SELECT repo_id, stmt_id, upper(regexp_extract(raw, '{_DEF.replace("'", "''")}', 1, 'i')) AS object_kind, upper(regexp_extract(raw, '{_DEF.replace("'", "''")}', 2, 'i')) AS name FROM statements WHERE raw IS NOT NULL),
u AS (SELECT DISTINCT repo_id, stmt_id, name FROM (SELECT repo_id, stmt_id, unnest(regexp_extract_all(upper(raw), '[A-Z_][A-Z0-9_]*')) AS name FROM statements WHERE raw IS NOT NULL))
SELECT repo_id, object_kind, count(*) AS n_unused FROM d WHERE name <> '' AND name NOT IN {project.NO_OBJECT} AND NOT EXISTS (SELECT 1 FROM u WHERE u.repo_id = d.repo_id AND u.name = d.name AND u.stmt_id <> d.stmt_id) GROUP BY ALL""",
    "unused_views": f"""WITH v AS (SELECT repo_id, {_BARE.format('name')} AS name, dependencies FROM schema_views WHERE name IS NOT NULL),
u AS (SELECT repo_id, name AS by_name, {_BARE.format('dep')} AS name FROM (SELECT repo_id, name, unnest(dependencies) AS dep FROM v) WHERE dep IS NOT NULL)
SELECT DISTINCT repo_id, name FROM v WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM u WHERE u.repo_id = v.repo_id AND u.name = v.name AND u.by_name <> v.name)""",
    "duplicate_queries": f"""WITH m AS (SELECT stmt_id, file, query_index, {_MASKED} AS print FROM statements WHERE raw IS NOT NULL AND NOT regexp_matches(upper(raw), 'CREATE |ALTER |DROP ')),
k AS (SELECT stmt_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY print) AS n_copies FROM m WINDOW w AS (PARTITION BY print ORDER BY file, query_index, stmt_id)) SELECT stmt_id, n_copies FROM k WHERE r > 1""",
    "fix_report": "SELECT coalesce(lower(fix.confidence), 'unsafe') AS confidence, count(*) AS n_fixes, sum(coalesce(fix.is_safe, FALSE)::INT)::BIGINT AS n_safe FROM issues WHERE fix IS NOT NULL GROUP BY 1",
}
