"""Filters, aggregates and reports over the issues and statements tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataql.operators import filters, reporting
from strataql.sources.tables import table

#: Overrides and lists as a configuration would give them.
OVERRIDES = {"SEC-GRANTX-001": "critical", "COST-STORE-007": "info"}
ENABLED, DISABLED = ["SEC-GRANTX", "PERF-PAGING", "QUAL-FORMAT-008"], ["SEC-GRANTX-002"]


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """Findings once each, with severity and rule id cleaned; unknown severities stay.

    Of several deliveries the latest counts, of those at one time the one whose line, column,
    severity and rule sort last. The aggregation combines before its shuffle.
    """
    rows = table(spark, folder, "issues")
    latest = rows.groupBy("issue_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "issue_id"]), F.struct("loaded_at", "line_no", "col_no", "severity", "rule_id")).alias("r")).select("issue_id", "r.*")
    return latest.withColumns({"severity": F.lower(F.trim("severity")), "rule_id": F.upper(F.trim("rule_id"))})


ISSUES_SQL = """i AS (
  SELECT * REPLACE (lower(trim(severity)) AS severity, upper(trim(rule_id)) AS rule_id)
  FROM issues QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY loaded_at DESC NULLS LAST, line_no DESC NULLS LAST, col_no DESC NULLS LAST, severity DESC NULLS LAST, rule_id DESC NULLS LAST) = 1)"""


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Statements by the context of their file and text."""
    st = table(spark, folder, "statements")
    return st.groupBy(filters.source_context(F.col("file"), F.col("raw")).alias("context")).agg(F.count("*").alias("n_statements"))


def context_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that count in their file's context."""
    found = issues(spark, folder).withColumn("context", filters.source_context(F.col("file"), F.lit(None).cast("string")))
    return found.filter(filters.counts_in_context(F.col("context"), F.col("rule_id"))).groupBy("context").agg(F.count("*").alias("n_findings"))


def allow_deny(spark: SparkSession, folder: str) -> DataFrame:
    """Findings left by allow and deny lists."""
    return issues(spark, folder).filter(filters.allowed(F.col("rule_id"), ENABLED, DISABLED)).groupBy("rule_id").agg(F.count("*").alias("n_findings"))


def severity_override(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by severity after overrides."""
    return filters.override_severity(issues(spark, folder), OVERRIDES).groupBy("severity").agg(F.count("*").alias("n_findings"))


def suppressions(spark: SparkSession, folder: str) -> DataFrame:
    """Findings left by directives: each statement's text, with a directive on top of every fifth, is a source."""
    p = filters.DIRECTIVE_PREFIX
    st = table(spark, folder, "statements").filter("raw IS NOT NULL")
    top = F.when(F.col("stmt_id") % 5 == 0, f"-- {p}-disable-next-line PERF\n").when(F.col("stmt_id") % 5 == 1, f"-- {p}-disable SEC, COST\n").when(F.col("stmt_id") % 5 == 2, f"-- {p}-disable-file\n").otherwise("")
    sources = st.select(F.col("stmt_id").cast("string").alias("file"), F.concat(top, "raw").alias("content"))
    found = issues(spark, folder).filter("stmt_id IS NOT NULL").select(F.col("stmt_id").cast("string").alias("file"), F.lit(2).alias("line_no"), "rule_id", "issue_id")
    left = filters.unsuppressed(found, filters.directives(sources))
    return left.groupBy(F.substring_index("rule_id", "-", 1).alias("family")).agg(F.count("*").alias("n_findings"))


def baseline_new(spark: SparkSession, folder: str) -> DataFrame:
    """Findings after a baseline of those detected before 2024, by repository."""
    found = issues(spark, folder)
    known = filters.baseline(found.filter("detected_at < TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    return filters.new_findings(found, known).groupBy("repo_id").agg(F.count("*").alias("n_new"), F.min("fingerprint").alias("first_print"))


def query_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct statements up to white space and letter case, and how often each kind recurs."""
    st = table(spark, folder, "statements").filter("raw IS NOT NULL").groupBy(filters.query_key(F.col("raw")).alias("k")).agg(F.count("*").alias("n"))
    return st.groupBy("n").agg(F.count("*").alias("n_queries"))


def incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Statements whose text no statement loaded before 2024 had."""
    st = table(spark, folder, "statements").filter("raw IS NOT NULL").withColumn("content_sha", F.sha2("raw", 256))
    old = st.filter("loaded_at < TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    return filters.unprocessed(st, old).groupBy("repo_id").agg(F.count("*").alias("n_statements"))


def statistics_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.zero_filled(issues(spark, folder), "severity", list(reporting.SEVERITIES))


DIMENSIONS = ["security", "performance", "reliability", "maintainability", "portability", "quality", "cost", "compliance", "migration", "schema", "business"]


def statistics_by_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.zero_filled(issues(spark, folder).withColumn("dimension", F.lower(F.trim("dimension"))), "dimension", DIMENSIONS)


def complexity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every statement's complexity score and band."""
    scored = reporting.complexity(table(spark, folder, "statements"), issues(spark, folder))
    return scored.withColumn("band", reporting.band(F.col("score")))


def complexity_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Largest and mean complexity by repository."""
    scored = reporting.complexity(table(spark, folder, "statements"), issues(spark, folder))
    st = table(spark, folder, "statements").select("stmt_id", "repo_id")
    return scored.join(st, "stmt_id").groupBy("repo_id").agg(F.max("score").alias("max_score"), F.round(F.avg("score"), 4).alias("avg_score"))


def complexity_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Change of a statement's score against the time before, by its whitespace-free text."""
    scored = reporting.complexity(table(spark, folder, "statements"), issues(spark, folder))
    st = table(spark, folder, "statements").filter("raw IS NOT NULL").select("stmt_id", "parsed_at", F.sha2(filters.query_key(F.col("raw")), 256).alias("query_sha"))
    return reporting.trend(scored.join(st, "stmt_id"), "query_sha", "parsed_at", ["stmt_id"]).select("stmt_id", "score", "trend")


def health_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Health by file."""
    return reporting.health(issues(spark, folder), ["file"])


def heat_map(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.heat_map(issues(spark, folder))


def cube(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by dimension and severity with all subtotals."""
    counted = issues(spark, folder).cube("dimension", "severity").agg(F.count("*").alias("n_findings"), F.grouping_id().alias("level"))
    return counted.select("dimension", "severity", F.col("level").cast("int").alias("level"), "n_findings")


def spectrum(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.spectrum(issues(spark, folder))


def top_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent rules; a report's top list."""
    return issues(spark, folder).groupBy("rule_id").agg(F.count("*").alias("n_findings")).orderBy(F.desc("n_findings"), "rule_id").limit(10)


def top_complex(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most complex statements; a report's top list."""
    return complexity_scores(spark, folder).orderBy(F.desc("score"), "stmt_id").limit(10)


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The four dimensions with most findings; a report's top list."""
    return issues(spark, folder).groupBy("dimension").agg(F.count("*").alias("n_findings")).orderBy(F.desc("n_findings"), "dimension").limit(4)


def by_severity_order(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of each file in falling weight: their rank."""
    order = Window.partitionBy("file").orderBy(F.desc(reporting.weight(F.col("severity"))), "issue_id")
    return issues(spark, folder).select("issue_id", F.row_number().over(order).alias("rank"))


def grouped_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """Findings and their rules by file; a missing file is <stdin>."""
    rules = F.concat_ws(",", F.array_sort(F.collect_set("rule_id")))
    return issues(spark, folder).groupBy(F.coalesce("file", F.lit("<stdin>")).alias("file")).agg(F.count("*").alias("n_findings"), rules.alias("rules"))


def exit_codes(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.exit_codes(issues(spark, folder))


def compared(spark: SparkSession, folder: str) -> DataFrame:
    """Findings detected before 2024 against those since."""
    found = issues(spark, folder)
    cut = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    return reporting.compared(found.filter(f"detected_at < {cut}"), found.filter(f"detected_at >= {cut}"))


def session_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals over days of detection, info left out."""
    daily = issues(spark, folder).filter("severity IN ('critical', 'high', 'medium', 'low') AND detected_at IS NOT NULL").groupBy(F.to_date("detected_at").alias("day")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))  # one row a day
    return daily.select(F.col("day").cast("string").alias("day"), F.col("n").alias("n_findings"), total.alias("n_so_far"))


def fixes(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes by rule, confidence and safety."""
    found = issues(spark, folder).filter("fix IS NOT NULL")
    return found.groupBy("rule_id", F.lower(F.trim("fix.confidence")).alias("confidence"), F.col("fix.is_safe").alias("is_safe")).agg(F.count("*").alias("n_fixes"), F.min("fix.description").alias("description"))


def safe_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """Safe fixes, once for each statement, rule, replacement and snippet."""
    found = issues(spark, folder).filter("fix.is_safe AND stmt_id IS NOT NULL")
    return found.select("stmt_id", "rule_id", F.col("fix.replacement").alias("replacement"), "snippet").distinct().groupBy("rule_id").agg(F.count("*").alias("n_fixes"))


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Workflow annotation lines, as digests by level."""
    line = reporting.annotation(F.col("severity"), F.col("file"), F.col("line_no"), F.col("col_no"), F.col("rule_id"), F.col("message"))
    return issues(spark, folder).filter("rule_id IS NOT NULL AND line_no IS NOT NULL AND col_no IS NOT NULL").select("issue_id", F.sha2(line, 256).alias("line_sha"))


def csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Report rows in CSV, as digests."""
    line = reporting.csv_line(*[F.col(c) for c in ("severity", "rule_id", "dimension", "message", "file", "line_no", "snippet")])
    return issues(spark, folder).select("issue_id", F.sha2(line, 256).alias("line_sha"))


def html_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Report rows in HTML, as digests."""
    row = reporting.html_row(*[F.col(c) for c in ("severity", "rule_id", "message", "file", "snippet")])
    return issues(spark, folder).select("issue_id", F.sha2(row, 256).alias("row_sha"))


def sarif_rules(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.sarif_rules(issues(spark, folder).filter("rule_id IS NOT NULL"))


def sarif_results(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.sarif_results(issues(spark, folder))


def orphan_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Findings whose rule the catalogue table doesn't have."""
    rules = table(spark, folder, "rules").select(F.upper(F.trim("rule_id")).alias("rule_id"))
    return issues(spark, folder).join(rules, "rule_id", "left_anti").groupBy("rule_id").agg(F.count("*").alias("n_findings"))


def late_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by whole days between detection and loading."""
    days = F.datediff(F.to_date("loaded_at"), F.to_date("detected_at"))
    return issues(spark, folder).groupBy(days.alias("days_late")).agg(F.count("*").alias("n_findings"))


QUERIES = {
    f.__name__: f
    for f in (
        contexts, context_filter, allow_deny, severity_override, suppressions, baseline_new, query_cache, incremental, statistics_by_severity, statistics_by_dimension,
        complexity_scores, complexity_summary, complexity_trend, health_scores, heat_map, cube, spectrum, top_rules, top_complex, panel, by_severity_order, grouped_by_file,
        exit_codes, compared, session_totals, fixes, safe_fixes, annotations, csv_lines, html_rows, sarif_rules, sarif_results, orphan_rules, late_findings,
    )
}

_W = reporting.by_severity_sql("severity", reporting.SEVERITY_WEIGHT)
_HEALTH = reporting.by_severity_sql("severity", reporting.HEALTH_COST)
_EXTRA = reporting.by_severity_sql("severity", reporting.COMPLEXITY_COST)
_KEY = r"upper(trim(regexp_replace(raw, '\s+', ' ', 'g')))"
_PRINT = r"substr(sha256(concat_ws('|', upper(rule_id), coalesce(file, ''), trim(regexp_replace(coalesce(snippet, ''), '\s+', ' ', 'g')))), 1, 16)"
_SCORED = f"""x AS (SELECT stmt_id, sum({_EXTRA}) AS extra FROM i WHERE stmt_id IS NOT NULL GROUP BY 1),
scored AS (SELECT s.stmt_id, least(greatest(coalesce(10 + 10 * len(regexp_extract_all(raw, '\\bJOIN\\b', 0, 'i')) + 15 * greatest(len(regexp_extract_all(raw, '\\bSELECT\\b', 0, 'i')) - 1, 0)
  + 5 * len(regexp_extract_all(raw, '\\b(?:COUNT|SUM|AVG|MIN|MAX)\\s*\\(', 0, 'i')), 0) + coalesce(extra, 0), 0), 100)::INT AS score FROM statements s LEFT JOIN x USING (stmt_id))"""
_BAND = "CASE WHEN score < 40 THEN 'OPTIMAL' WHEN score < 70 THEN 'COMPLEX' ELSE 'CRITICAL' END"


def _values(column: str, values) -> str:
    rows = ", ".join(f"('{v}')" for v in values)
    return f"WITH {ISSUES_SQL} SELECT d.{column}, count(i.issue_id) AS n_findings FROM (VALUES {rows}) d({column}) LEFT JOIN i ON lower(trim(i.{column})) = d.{column} GROUP BY 1"


def _escape(c: str, prop: bool) -> str:
    out = f"replace(replace(replace({c}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
    return f"replace(replace({out}, ':', '%3A'), ',', '%2C')" if prop else out


def _csv(c: str) -> str:
    t = f"coalesce({c}::VARCHAR, '')"
    return f"CASE WHEN regexp_matches({t}, '[\",\\r\\n]') THEN '\"' || replace({t}, '\"', '\"\"') || '\"' ELSE {t} END"


def _html(c: str) -> str:
    t = f"coalesce({c}::VARCHAR, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"'<td>' || {t} || '</td>'"


_MESSAGE = "coalesce(message, '')"
_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"

SQL = {
    "contexts": f"SELECT {filters.source_context_sql('file', 'raw')} AS context, count(*) AS n_statements FROM statements GROUP BY 1",
    "context_filter": f"WITH {ISSUES_SQL}, c AS (SELECT *, {filters.source_context_sql('file', 'NULL::VARCHAR')} AS context FROM i) SELECT context, count(*) AS n_findings FROM c WHERE {filters.counts_in_context_sql('context', 'rule_id')} GROUP BY 1",
    "allow_deny": f"WITH {ISSUES_SQL}, f AS (SELECT *, array_to_string(string_split(rule_id, '-')[1:2], '-') AS family FROM i) SELECT rule_id, count(*) AS n_findings FROM f WHERE (rule_id IN {tuple(ENABLED)} OR family IN {tuple(ENABLED)}) AND rule_id NOT IN ('{DISABLED[0]}') AND family NOT IN ('{DISABLED[0]}') GROUP BY 1",
    "severity_override": f"WITH {ISSUES_SQL} SELECT CASE rule_id {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in OVERRIDES.items())} ELSE severity END AS severity, count(*) AS n_findings FROM i GROUP BY 1",
    # A statement's first line after the directive is line 2, where its findings are put; the next line of code may come later.
    "suppressions": f"""WITH {ISSUES_SQL}, s AS (SELECT stmt_id, string_split(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[1] AS line FROM statements WHERE raw IS NOT NULL)
SELECT split_part(rule_id, '-', 1) AS family, count(*) AS n_findings FROM i LEFT JOIN s USING (stmt_id) WHERE i.stmt_id IS NOT NULL AND (s.stmt_id IS NULL OR rule_id IS NULL OR NOT (
  (stmt_id % 5 = 0 AND trim(line) <> '' AND NOT starts_with(ltrim(line), '--') AND starts_with(rule_id, 'PERF-')) OR (stmt_id % 5 = 1 AND (starts_with(rule_id, 'SEC-') OR starts_with(rule_id, 'COST-'))) OR stmt_id % 5 = 2)) GROUP BY 1""",
    "baseline_new": f"WITH {ISSUES_SQL}, p AS (SELECT *, {_PRINT} AS fingerprint FROM i), k AS (SELECT DISTINCT rule_id, file, fingerprint FROM p WHERE detected_at < TIMESTAMP '2024-01-01') SELECT repo_id, count(*) AS n_new, min(fingerprint) AS first_print FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.fingerprint = p.fingerprint AND k.rule_id = p.rule_id AND k.file IS NOT DISTINCT FROM p.file) GROUP BY 1",
    "query_cache": f"WITH q AS (SELECT {_KEY} AS k, count(*) AS n FROM statements WHERE raw IS NOT NULL GROUP BY 1) SELECT n, count(*) AS n_queries FROM q GROUP BY 1",
    "incremental": "SELECT repo_id, count(*) AS n_statements FROM statements s WHERE raw IS NOT NULL AND NOT EXISTS (SELECT 1 FROM statements o WHERE o.raw = s.raw AND o.loaded_at < TIMESTAMP '2024-01-01') GROUP BY 1",
    "statistics_by_severity": _values("severity", reporting.SEVERITIES),
    "statistics_by_dimension": _values("dimension", DIMENSIONS),
    "complexity_scores": f"WITH {ISSUES_SQL}, {_SCORED} SELECT stmt_id, score, {_BAND} AS band FROM scored",
    "complexity_summary": f"WITH {ISSUES_SQL}, {_SCORED} SELECT repo_id, max(score) AS max_score, round(avg(score), 4) AS avg_score FROM scored JOIN statements USING (stmt_id) GROUP BY 1",
    "complexity_trend": f"WITH {ISSUES_SQL}, {_SCORED} SELECT stmt_id, score, score - lag(score) OVER (PARTITION BY {_KEY} ORDER BY parsed_at NULLS FIRST, stmt_id) AS trend FROM scored JOIN statements USING (stmt_id) WHERE raw IS NOT NULL",
    "health_scores": f"WITH {ISSUES_SQL} SELECT file, greatest(0, 100 - least(sum({_HEALTH}), 100))::INT AS health FROM i GROUP BY 1",
    "heat_map": f"WITH {ISSUES_SQL} SELECT dimension, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM i WHERE severity IN ('critical', 'high', 'medium', 'low') GROUP BY 1",
    "cube": f"WITH {ISSUES_SQL} SELECT dimension, severity, grouping(dimension, severity)::INT AS level, count(*) AS n_findings FROM i GROUP BY CUBE (dimension, severity)",
    "spectrum": f"WITH {ISSUES_SQL} SELECT rule_id, count(*) AS n_findings, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM i GROUP BY 1",
    "top_rules": f"WITH {ISSUES_SQL} SELECT rule_id, count(*) AS n_findings FROM i GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10",
    "top_complex": f"WITH {ISSUES_SQL}, {_SCORED} SELECT stmt_id, score, {_BAND} AS band FROM scored ORDER BY score DESC, stmt_id LIMIT 10",
    "panel": f"WITH {ISSUES_SQL} SELECT dimension, count(*) AS n_findings FROM i GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 4",
    "by_severity_order": f"WITH {ISSUES_SQL} SELECT issue_id, row_number() OVER (PARTITION BY file ORDER BY {_W} DESC, issue_id)::INT AS rank FROM i",
    "grouped_by_file": f"WITH {ISSUES_SQL} SELECT coalesce(file, '<stdin>') AS file, count(*) AS n_findings, coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id), '') AS rules FROM i GROUP BY 1",
    "exit_codes": f"WITH {ISSUES_SQL}, m AS (SELECT coalesce(max({_W}), 0) AS w FROM i) SELECT CASE WHEN w >= 5 THEN 3 WHEN w = 4 THEN 2 WHEN w >= 2 THEN 1 ELSE 0 END AS result_code, CASE WHEN w >= 4 THEN 2 ELSE 0 END AS fail_code FROM m",
    "compared": f"WITH {ISSUES_SQL}, c AS (SELECT count(*) FILTER (detected_at < TIMESTAMP '2024-01-01') AS n_before, count(*) FILTER (detected_at >= TIMESTAMP '2024-01-01') AS n_after FROM i) SELECT n_before, n_after, n_after - n_before AS delta, CASE WHEN n_before > 0 THEN round((n_after - n_before) * 100.0::DOUBLE / n_before, 4) END AS percent FROM c",
    "session_totals": f"WITH {ISSUES_SQL}, d AS (SELECT detected_at::DATE::VARCHAR AS day, count(*) AS n_findings FROM i WHERE severity IN ('critical', 'high', 'medium', 'low') AND detected_at IS NOT NULL GROUP BY 1) SELECT day, n_findings, sum(n_findings) OVER (ORDER BY day)::BIGINT AS n_so_far FROM d",
    "fixes": f"WITH {ISSUES_SQL} SELECT rule_id, lower(trim(fix.confidence)) AS confidence, fix.is_safe AS is_safe, count(*) AS n_fixes, min(fix.description) AS description FROM i WHERE fix IS NOT NULL GROUP BY 1, 2, 3",
    "safe_fixes": f"WITH {ISSUES_SQL}, f AS (SELECT DISTINCT stmt_id, rule_id, fix.replacement AS replacement, snippet FROM i WHERE fix.is_safe AND stmt_id IS NOT NULL) SELECT rule_id, count(*) AS n_fixes FROM f GROUP BY 1",
    "annotations": f"WITH {ISSUES_SQL} SELECT issue_id, sha256('::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END || ' ' || CASE WHEN file IS NULL THEN '' ELSE 'file=' || {_escape('file', True)} || ',' END || 'line=' || line_no || ',col=' || col_no || '::' || rule_id || ' ' || {_escape(_MESSAGE, False)}) AS line_sha FROM i WHERE rule_id IS NOT NULL AND line_no IS NOT NULL AND col_no IS NOT NULL",
    "csv_lines": f"WITH {ISSUES_SQL} SELECT issue_id, sha256({' || chr(44) || '.join(_csv(c) for c in ('severity', 'rule_id', 'dimension', 'message', 'file', 'line_no', 'snippet'))}) AS line_sha FROM i".replace("|| CASE", "|| (CASE").replace("sha256(CASE", "sha256((CASE").replace(" END", " END)"),
    "html_rows": f"WITH {ISSUES_SQL} SELECT issue_id, sha256('<tr>' || {' || '.join(_html(c) for c in ('severity', 'rule_id', 'message', 'file', 'snippet'))} || '</tr>') AS row_sha FROM i",
    "sarif_rules": f"""WITH {ISSUES_SQL}, f AS (SELECT rule_id, arg_min({{'m': message, 'l': {_LEVEL}}}, issue_id) AS f FROM i WHERE rule_id IS NOT NULL GROUP BY 1)
SELECT rule_id, '{{"id":' || to_json(rule_id) || ',"shortDescription":{{' || coalesce('"text":' || to_json(f.m), '') || '}},"defaultConfiguration":{{"level":"' || f.l || '"}}}}' AS rule FROM f""",
    "sarif_results": f"""WITH {ISSUES_SQL} SELECT issue_id, '{{' || CASE WHEN rule_id IS NULL THEN '' ELSE '"ruleId":' || to_json(rule_id) || ',' END || '"level":"' || {_LEVEL} || '","message":{{"text":' || to_json(coalesce(message, ''))
  || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(coalesce(file, '<stdin>')) || '}},"region":{{"startLine":' || greatest(coalesce(line_no, 1), 1) || ',"startColumn":' || greatest(coalesce(col_no, 1), 1) || '}}}}}}]}}' AS result FROM i""",
    "orphan_rules": f"WITH {ISSUES_SQL} SELECT i.rule_id, count(*) AS n_findings FROM i WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE upper(trim(r.rule_id)) = i.rule_id) GROUP BY 1",
    "late_findings": f"WITH {ISSUES_SQL} SELECT date_diff('day', detected_at::DATE, loaded_at::DATE)::INT AS days_late, count(*) AS n_findings FROM i GROUP BY 1",
}
