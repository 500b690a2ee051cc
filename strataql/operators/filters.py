"""Which findings count: source context, suppressions, overrides, baselines and earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Contexts by path, in the order that decides.
PATH_CONTEXTS = [
    (r"(?:^|/)alembic/versions/", "migration"), (r"(?:^|/)alembic/", "migration"), (r"(?:^|/)migrations?/", "migration"), (r"(?:^|/)db/migrate/", "migration"),
    (r"(?:^|/)db/migrations/", "migration"), (r"(?:^|/)flyway/", "migration"), (r"(?:^|/)liquibase/", "migration"), (r"(?:^|/)prisma/migrations/", "migration"),
    (r"(?:^|/)src/main/resources/db/migration/", "migration"), (r"(?:^|/)tests?/", "test"), (r"(?:^|/)spec/", "test"), (r"(?:^|/)__tests__/", "test"),
    (r"(?:^|/)models?/.*\.sql$", "dbt_model"), (r"(?:^|/)dbt_models?/", "dbt_model"), (r"(?:^|/)[^/]*test[^/]*\.sql$", "test"), (r"(?:^|/)seeds?/", "seed"),
    (r"(?:^|/)fixtures?/", "seed"), (r"(?:^|/)schema\.sql$", "ddl_schema"), (r"(?:^|/)schema/", "ddl_schema"), (r"(?:^|/)ddl/", "ddl_schema"), (r"(?:^|/)src/", "application"),
    (r"\.(?:py|js|ts|jsx|tsx|java|go|rb|kt|cs|xml)$", "application"),
]
# Contexts by content, in the order that decides.
CONTENT_CONTEXTS = [
    (r"(?i)revision\s*[:=].*\n.*down_revision", "migration"), (r"class\s+\w*Migration\w*\s*\(", "migration"), (r"def\s+(up|down)\s*\(", "migration"),
    (r"(?i)--\s*(?:flyway|liquibase|prisma)", "migration"), (r"(?i)--\s*migrate:\s*(up|down)", "migration"), (r"\{\{\s*ref\s*\(", "dbt_model"),
    (r"\{\%\s*(config|materialization)", "dbt_model"), (r"(?i)CREATE\s+(OR\s+REPLACE\s+)?VIEW\b", "view_def"), (r"(?i)CREATE\s+(OR\s+REPLACE\s+)?(PROCEDURE|FUNCTION)\b", "stored_proc"),
]
# Families that count in a context (all where it isn't listed), and rules that don't.
ALLOWED_IN = {"migration": ("SEC-", "REL-"), "test": ("SEC-", "REL-"), "seed": ("SEC-", "REL-"), "ddl_schema": ("SEC-", "REL-", "COMP-")}
DENIED_IN = {
    "migration": ("SEC-INJ-005",), "test": ("REL-FK-002", "REL-DEAD-002", "SEC-AUTHZ-003"), "seed": ("SEC-INJ-005",),
    "application": ("QUAL-DBT-001", "QUAL-DBT-002"), "adhoc": ("QUAL-DBT-001", "QUAL-DBT-002"), "dbt_model": ("PERF-SCAN-003",),
}

#: Words in front of a suppression directive; a parameter, since every tool has its own.
DIRECTIVE_PREFIX = "sqllint"


def source_context(path: Column, content: Column) -> Column:
    """The context of a source: by path, then by content, else adhoc."""
    out = None
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    for pattern, context in PATH_CONTEXTS:
        hit = F.coalesce(norm.rlike("(?i)" + pattern), F.lit(False))
        out = F.when(hit, context) if out is None else out.when(hit, context)
    for pattern, context in CONTENT_CONTEXTS:
        out = out.when(F.coalesce(content.rlike(pattern), F.lit(False)), context)
    return out.otherwise("adhoc")


def source_context_sql(path: str, content: str) -> str:
    whens = [f"WHEN regexp_matches({path}, '{p}', 'i') THEN '{c}'" for p, c in PATH_CONTEXTS]
    whens += [f"WHEN regexp_matches({content}, '{p.removeprefix('(?i)')}'{', ' + repr('i') if p.startswith('(?i)') else ''}) THEN '{c}'" for p, c in CONTENT_CONTEXTS]
    return f"CASE {' '.join(whens)} ELSE 'adhoc' END"


def counts_in_context(context: Column, rule_id: Column) -> Column:
    """Whether a rule's findings count in a context; the context, costly to tell, is told once."""
    return F.exists(F.array(context), lambda c: _counts(c, rule_id))


def _counts(context: Column, rule_id: Column) -> Column:
    ok = F.lit(True)
    for c, prefixes in ALLOWED_IN.items():
        allowed = F.lit(False)
        for p in prefixes:
            allowed = allowed | rule_id.startswith(p)
        ok = ok & ((context != c) | allowed)
    for c, rules in DENIED_IN.items():
        ok = ok & ((context != c) | ~rule_id.isin(*rules))
    return F.coalesce(ok, F.lit(True))


def counts_in_context_sql(context: str, rule_id: str) -> str:
    parts = [f"({context} <> '{c}' OR {' OR '.join(f'starts_with({rule_id}, {p!r})' for p in ps)})" for c, ps in ALLOWED_IN.items()]
    parts += [f"({context} <> '{c}' OR {rule_id} NOT IN ({', '.join(map(repr, rs))}))" for c, rs in DENIED_IN.items()]
    return "coalesce(" + " AND ".join(parts) + ", TRUE)"


def allowed(rule_id: Column, enabled: list[str], disabled: list[str]) -> Column:
    """Allow-list of ids or two-segment families (all where empty), less denied ids and families."""
    family = F.substring_index(rule_id, "-", 2)
    ok = (rule_id.isin(*enabled) | family.isin(*enabled)) if enabled else F.lit(True)
    return ok & ~(rule_id.isin(*disabled) | family.isin(*disabled)) if disabled else ok


def override_severity(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Severities replaced by rule id."""
    if not overrides:
        return findings
    to = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return findings.withColumn("severity", F.coalesce(to[F.col("rule_id")], F.col("severity")))


# ---------------------------------------------------------------------------------------------
# Suppressions


def directives(sources: DataFrame, file: str = "file", content: str = "content", prefix: str = DIRECTIVE_PREFIX) -> DataFrame:
    """file, scope (file, line or block), start_line, end_line (null: to the end), rule_prefix (null: all).

    Comments `-- <prefix>-disable-line`, `-disable-next-line`, `-disable-file`, `-disable` and
    `-enable`, each with rule ids or prefixes after it or none for all. A block begins on the line
    after `disable` and ends on the line before `enable` of the same rule; a second `disable` of an
    open block moves its start. A directive inside quotes doesn't count. Null and empty contents
    have none.
    """
    lines = sources.select(F.col(file).alias("file"), F.posexplode(F.split(content, "\r\n|\n|\r", -1)).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    # Quoted stretches of a line are cut out first, as long as they stand before the comment.
    bare = F.regexp_replace("line", r"""^((?:(?!--)[^'"`]|-(?!-))*)(?:'(?:[^']|'')*(?:'|$)|"(?:[^"]|"")*(?:"|$)|`(?:[^`]|``)*(?:`|$))""", "$1")
    for _ in range(8):
        bare = F.regexp_replace(bare, r"""^((?:(?!--)[^'"`])*)(?:'(?:[^']|'')*(?:'|$)|"(?:[^"]|"")*(?:"|$)|`(?:[^`]|``)*(?:`|$))""", "$1")
    # The regular expression is applied to the few lines that hold a directive at all.
    comment = F.regexp_extract(bare, r"(--.*)$", 1)
    pattern = rf"(?i)--\s*{prefix}-(disable-line|disable-next-line|disable-file|disable|enable)(?:\s+(.*))?"
    code = (F.trim("line") != "") & ~F.ltrim("line").startswith("--")
    by_file = Window.partitionBy("file").orderBy("line_no")
    marked = lines.withColumn("next_code", F.min(F.when(code, F.col("line_no"))).over(by_file.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    found = (
        marked.filter(F.col("line").rlike(rf"(?i){prefix}-(?:disable|enable)"))
        .withColumn("comment", comment)
        .filter(F.col("comment").rlike(pattern))
        .select("file", "line_no", "next_code", F.lower(F.regexp_extract("comment", pattern, 1)).alias("what"), F.trim(F.regexp_extract("comment", pattern, 2)).alias("ids"))
    )
    ids = F.when(F.col("ids") == "", F.array(F.lit(None).cast("string"))).otherwise(F.filter(F.transform(F.split("ids", ","), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    each = found.select("file", "line_no", "next_code", "what", F.explode(ids).alias("rule_prefix"))
    simple = each.filter(F.col("what").isin("disable-line", "disable-next-line", "disable-file")).select(
        "file",
        F.when(F.col("what") == "disable-file", "file").otherwise("line").alias("scope"),
        F.when(F.col("what") == "disable-line", F.col("line_no")).when(F.col("what") == "disable-next-line", F.col("next_code")).otherwise(1).alias("start_line"),
        F.when(F.col("what") == "disable-line", F.col("line_no")).when(F.col("what") == "disable-next-line", F.col("next_code")).alias("end_line"),
        "rule_prefix",
    ).filter((F.col("scope") == "file") | F.col("start_line").isNotNull())
    order = Window.partitionBy("file", "rule_prefix").orderBy("line_no")
    blocks = (
        each.filter(F.col("what").isin("disable", "enable"))
        .withColumns({"next_what": F.lead("what").over(order), "next_line": F.lead("line_no").over(order)})
        .filter("what = 'disable' AND (next_what IS NULL OR next_what = 'enable')")
        .select("file", F.lit("block").alias("scope"), (F.col("line_no") + 1).alias("start_line"), (F.col("next_line") - 1).alias("end_line"), "rule_prefix")
        .filter("end_line IS NULL OR start_line <= end_line")
    )
    return simple.unionByName(blocks)


def unsuppressed(findings: DataFrame, found: DataFrame) -> DataFrame:
    """Findings (file, line_no, rule_id and more) that no directive covers; a range join by file.

    A rule prefix covers ids that equal it or go on with a dash. Findings without a line or file
    stay.
    """
    d = found.select(F.col("file").alias("d_file"), "start_line", "end_line", "rule_prefix")
    rule = F.upper(F.col("rule_id"))
    covered = (
        (F.col("file") == F.col("d_file"))
        & (F.col("line_no") > 0)
        & (F.col("line_no") >= F.col("start_line"))
        & (F.col("end_line").isNull() | (F.col("line_no") <= F.col("end_line")))
        & (F.col("rule_prefix").isNull() | (rule == F.col("rule_prefix")) | rule.startswith(F.concat("rule_prefix", F.lit("-"))))
    )
    return findings.join(d, covered, "left_anti")


# ---------------------------------------------------------------------------------------------
# Baselines and caches


def fingerprint(rule_id: Column, file: Column, snippet: Column) -> Column:
    """16 hexadecimal digits of a finding that survive moved lines and changed white space."""
    norm = F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"\s+", " "))
    return F.substring(F.sha2(F.concat_ws("|", F.upper(rule_id), F.coalesce(file, F.lit("")), norm), 256), 1, 16)


def baseline(findings: DataFrame) -> DataFrame:
    """Distinct rule_id, file, fingerprint of the findings."""
    return findings.select("rule_id", "file", fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet")).alias("fingerprint")).distinct()


def save_baseline(known: DataFrame, path: str) -> None:
    """Write a baseline as JSON lines, over an earlier one."""
    known.write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline as it was saved; an error where there is none."""
    return spark.read.schema("rule_id string, file string, fingerprint string").json(path)


def new_findings(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings that aren't in a baseline; all repeated ones of a known finding go."""
    mine = findings.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet")))
    k = known.select(F.col("rule_id").alias("k_rule"), F.col("file").alias("k_file"), F.col("fingerprint").alias("k_print"))
    same = (mine.fingerprint == k.k_print) & (mine.rule_id == k.k_rule) & mine.file.eqNullSafe(k.k_file)
    return mine.join(k, same, "left_anti")


def unprocessed(sources: DataFrame, processed: DataFrame, key: str = "content_sha") -> DataFrame:
    """Sources whose content hash an earlier run hasn't seen: the incremental form of a result cache."""
    return sources.join(processed.select(key).distinct(), key, "left_anti")


def content_key(path: Column, content: Column, settings: str) -> Column:
    """The cache key of a source: path, content, settings."""
    return F.sha2(F.concat_ws("|", path, content, F.lit(settings)), 256)


def query_key(raw: Column) -> Column:
    """Statements that differ in white space and letter case share it."""
    return F.upper(F.trim(F.regexp_replace(raw, r"\s+", " ")))
