"""The catalogue's rules over the statements table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.functions.dialects import canonical_dialect_sql, gate_sql
from strataql.functions.predicates import sql_text
from strataql.operators.findings import firing, may_match, node_findings, pattern_findings, prepare, text_findings, with_rule_columns
from strataql.operators.schema_rules import project_findings
from strataql.operators.splitting import statement_type
from strataql.operators.structure import nodes, structured
from strataql.plans import corpus
from strataql.rules import catalog
from strataql.rules.spec import CRITICAL, PATTERN, Rule
from strataql.rules.text_rules import CONDITIONS, NO_FORM, UNFILTERED_COUNT, WITHOUT_LOOKAROUND
from strataql.sources.tables import table

PREPARED_SQL = f"prepared AS (SELECT *, {canonical_dialect_sql('dialect')} AS norm_dialect FROM statements WHERE raw IS NOT NULL)"


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(table(spark, folder, "statements"))


def _plain(dimension: str) -> list[Rule]:
    return [r for r in catalog.all_rules() if r.kind == PATTERN and not r.looks_around and r.dimension == dimension]


def _looking() -> list[Rule]:
    return [r for r in catalog.all_rules() if r.looks_around and r.rule_id not in NO_FORM]


def _by_pattern(dimension: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = pattern_findings(prepared(spark, folder), _plain(dimension), ["stmt_id"])
        return found.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.count_distinct("stmt_id").alias("n_statements"), F.min(F.sha2("snippet", 256)).alias("first_sha"))

    run.__doc__ = f"Matches of every {dimension} pattern: findings, statements, and a digest of the snippets."
    return run


def _pattern_sql(dimension: str) -> str:
    parts = [
        f"SELECT '{r.rule_id}' AS rule_id, stmt_id, unnest(regexp_extract_all(raw, {sql_text(r.pattern)}, 0, 'i')) AS snippet FROM prepared WHERE {gate_sql('norm_dialect', r.dialect_list)}"
        for r in _plain(dimension)
    ]
    return f"WITH {PREPARED_SQL}, found AS ({' UNION ALL '.join(parts)}) SELECT rule_id, count(*) AS n_findings, count(DISTINCT stmt_id) AS n_statements, min(sha256(snippet)) AS first_sha FROM found GROUP BY rule_id"


def _fires(rule: Rule):
    return lambda upper: may_match(rule, upper) & F.col("raw").rlike(rule.java_pattern)


def rules_by_context(spark: SparkSession, folder: str) -> DataFrame:
    """Statements on which each pattern fires that has no form without lookaround."""
    conditions = {r.rule_id: _fires(r) for r in catalog.all_rules() if r.rule_id in NO_FORM}
    return firing(prepared(spark, folder), conditions, ["stmt_id"]).groupBy("rule_id").agg(F.count("*").alias("n_statements"))


def every_finding(statements: DataFrame, carry: list[str]) -> DataFrame:
    """Carried columns and rule_id of every finding of all rules over single statements."""
    ready = prepare(statements)
    rules = catalog.all_rules()
    found = pattern_findings(ready, [r for r in rules if r.kind == PATTERN], carry).select(*carry, "rule_id")
    found = found.unionByName(text_findings(ready, rules, carry, {UNFILTERED_COUNT: CONDITIONS[UNFILTERED_COUNT]}))
    counted = node_findings(structured(statements, carry), carry)
    return found.unionByName(counted.select(*carry, F.explode(F.array_repeat("rule_id", F.col("n_findings"))).alias("rule_id")))


def rules_all(spark: SparkSession, folder: str) -> DataFrame:
    """Findings and statements of every rule of the catalogue over single statements: patterns, texts, structure."""
    found = every_finding(table(spark, folder, "statements"), ["stmt_id"])
    return found.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.count_distinct("stmt_id").alias("n_statements"))


def rules_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Each rule over texts written for it: how many on which it must fire do, and of the others don't.

    The texts don't depend on the folder's tables; rules over several statements see those of a case.
    """
    cases = spark.createDataFrame(corpus.rows(), "case long, rule_id string, fires boolean, seq long, dialect string, raw string")
    texts = cases.select("case", "seq", "dialect", "raw", statement_type(F.col("raw")).alias("query_type"), (F.col("case") * 100 + F.col("seq")).alias("stmt_id"))
    found = every_finding(texts, ["case"]).unionByName(project_findings(texts, "case", "seq").select(F.col("scope").alias("case"), "rule_id"))
    fired = found.distinct().withColumn("fired", F.lit(True))
    each = cases.filter("seq = 0").join(fired, ["case", "rule_id"], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    return each.groupBy("rule_id").agg(F.count_if(F.col("fires") & F.col("fired")).alias("n_firing"), F.count_if(~F.col("fires") & ~F.col("fired")).alias("n_silent"))


def rules_lookaround(spark: SparkSession, folder: str) -> DataFrame:
    """Statements on which each pattern with lookaround fires."""
    rules = _looking()
    conditions = {r.rule_id: _fires(r) for r in rules}
    return firing(prepared(spark, folder), conditions, ["stmt_id"]).groupBy("rule_id").agg(F.count("*").alias("n_statements"))


def _form(rule: Rule) -> tuple[str, str]:
    """A and B of "A and not B": given, or read off a pattern that ends in one negative lookahead."""
    if rule.rule_id in WITHOUT_LOOKAROUND:
        return WITHOUT_LOOKAROUND[rule.rule_id]
    m = re.fullmatch(r"(.*?)\(\?!(.*)\)", rule.pattern, re.DOTALL)
    return m[1], f"{m[1]}(?:{m[2]})"


def _lookaround_sql() -> str:
    parts = []
    for r in _looking():
        a, b = _form(r)
        without = f" AND NOT regexp_matches(raw, {sql_text(b)}, 'i')" if b else ""
        parts.append(f"SELECT '{r.rule_id}' AS rule_id, stmt_id FROM prepared WHERE {gate_sql('norm_dialect', r.dialect_list)} AND regexp_matches(raw, {sql_text(a)}, 'i'){without}")
    return f"WITH {PREPARED_SQL}, found AS ({' UNION ALL '.join(parts)}) SELECT rule_id, count(*) AS n_statements FROM found GROUP BY rule_id"


def rules_text(spark: SparkSession, folder: str) -> DataFrame:
    """Statements on which each text condition holds."""
    found = text_findings(prepared(spark, folder), catalog.all_rules(), ["stmt_id"], {UNFILTERED_COUNT: CONDITIONS[UNFILTERED_COUNT]})
    return found.groupBy("rule_id").agg(F.count("*").alias("n_statements"))


def _text_sql() -> str:
    dialects = {r.rule_id: r.dialect_list for r in catalog.all_rules()}
    parts = [f"SELECT '{i}' AS rule_id, stmt_id FROM prepared WHERE {gate_sql('norm_dialect', dialects.get(i, []))} AND {p.sql()}" for i, p in CONDITIONS.items()]
    return f"WITH {PREPARED_SQL}, found AS ({' UNION ALL '.join(parts)}) SELECT rule_id, count(*) AS n_statements FROM found GROUP BY rule_id"


def table_rules(spark: SparkSession, folder: str) -> list[Rule]:
    """Pattern rules of the rules table: a parameter table, read on the driver."""
    rows = table(spark, folder, "rules").filter("kind = 'pattern' AND pattern IS NOT NULL").orderBy("rule_id").collect()
    return [catalog.CustomRule(r["rule_id"], r["name"] or "", (r["severity"] or "medium").lower(), ",".join(r["dialects"] or []), PATTERN, r["pattern"], r["dimension"] or "quality") for r in rows]


def rules_from_table(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of the patterns that the rules table brings."""
    found = pattern_findings(prepared(spark, folder), table_rules(spark, folder), ["stmt_id"])
    return found.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.count_distinct("stmt_id").alias("n_statements"))


def findings_by_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all patterns without lookaround by dimension and severity."""
    rules = [r for r in catalog.all_rules() if r.kind == PATTERN and not r.looks_around]
    found = with_rule_columns(pattern_findings(prepared(spark, folder), rules, ["stmt_id"]), rules)
    return found.groupBy("dimension", "severity").agg(F.count("*").alias("n_findings"))


def _dimension_sql() -> str:
    parts = [
        f"SELECT '{r.dimension}' AS dimension, '{r.severity}' AS severity, unnest(regexp_extract_all(raw, {sql_text(r.pattern)}, 0, 'i')) AS snippet FROM prepared WHERE {gate_sql('norm_dialect', r.dialect_list)}"
        for r in catalog.all_rules()
        if r.kind == PATTERN and not r.looks_around
    ]
    return f"WITH {PREPARED_SQL}, found AS ({' UNION ALL '.join(parts)}) SELECT dimension, severity, count(*) AS n_findings FROM found GROUP BY ALL"


def security_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Critical security findings, which carry an alert in their metadata."""
    rules = [r for r in _plain("security") if r.severity == CRITICAL]
    found = pattern_findings(prepared(spark, folder), rules, ["stmt_id"])
    alert = F.map_concat(F.create_map().cast("map<string,string>"), F.create_map(F.lit("security_alert"), F.lit("true")))
    return found.withColumn("metadata", alert).groupBy("rule_id", F.col("metadata")["security_alert"].alias("security_alert")).agg(F.count("*").alias("n_findings"))


def first_match_only(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern analyzer's form: the first match of each pattern in a statement."""
    found = pattern_findings(prepared(spark, folder), _plain("cost"), ["stmt_id"]).filter("ordinal = 0")
    return found.groupBy("rule_id").agg(F.count("*").alias("n_first"))


def rules_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the structural rules."""
    found = node_findings(structured(table(spark, folder, "statements"), ["stmt_id"]), ["stmt_id"])
    return found.groupBy("rule_id").agg(F.sum("n_findings").alias("n_findings"), F.count("*").alias("n_statements"))


def statement_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Frames by kind, role and depth: the nodes relation, summed up."""
    found = nodes(structured(table(spark, folder, "statements"), ["stmt_id"]), "stmt_id")
    return found.groupBy("kind", "role", "depth").agg(F.count("*").alias("n_frames"), F.sum(F.size("tables")).alias("n_tables"), F.sum(F.size("columns")).alias("n_columns"), F.sum(F.size("joins")).alias("n_joins"))


def rule_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue by dimension, severity and kind."""
    return catalog.stats(catalog.rules_frame(spark))


def table_rule_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The rules table by dimension, severity and kind."""
    return catalog.stats(table(spark, folder, "rules"))


DIMENSIONS = ("security", "performance", "reliability", "compliance", "quality", "cost")

QUERIES = {f"rules_{d}": _by_pattern(d) for d in DIMENSIONS} | {
    "rules_lookaround": rules_lookaround,
    "rules_by_context": rules_by_context,
    "rules_all": rules_all,
    "rules_corpus": rules_corpus,
    "rules_text": rules_text,
    "rules_from_table": rules_from_table,
    "rules_nodes": rules_nodes,
    "statement_nodes": statement_nodes,
    "findings_by_dimension": findings_by_dimension,
    "security_alerts": security_alerts,
    "first_match_only": first_match_only,
    "rule_stats": rule_stats,
    "table_rule_stats": table_rule_stats,
}


def _stats_values() -> str:
    return ", ".join(f"('{r.rule_id}', '{r.severity}', '{r.dimension}', '{r.kind}', {len(r.dialect_list)})" for r in catalog.all_rules())


SQL = {f"rules_{d}": _pattern_sql(d) for d in DIMENSIONS} | {
    "rules_lookaround": _lookaround_sql(),
    "rules_corpus": "SELECT rule_id, 1::BIGINT AS n_firing, 1::BIGINT AS n_silent FROM (VALUES " + ", ".join(f"('{rule}')" for rule, *_ in corpus.PAIRS) + ") t(rule_id)",
    "rules_text": _text_sql(),
    "rules_from_table": f"""
WITH {PREPARED_SQL}, found AS (
  SELECT r.rule_id, s.stmt_id, unnest(regexp_extract_all(s.raw, r.pattern, 0, 'i')) AS snippet
  FROM prepared s JOIN rules r ON r.kind = 'pattern' AND r.pattern IS NOT NULL AND (len(r.dialects) = 0 OR list_contains(r.dialects, s.norm_dialect)))
SELECT rule_id, count(*) AS n_findings, count(DISTINCT stmt_id) AS n_statements FROM found GROUP BY rule_id""",
    "findings_by_dimension": _dimension_sql(),
    "security_alerts": "WITH "
    + PREPARED_SQL
    + ", found AS ("
    + " UNION ALL ".join(
        f"SELECT '{r.rule_id}' AS rule_id, unnest(regexp_extract_all(raw, {sql_text(r.pattern)}, 0, 'i')) AS snippet FROM prepared WHERE {gate_sql('norm_dialect', r.dialect_list)}"
        for r in _plain("security")
        if r.severity == CRITICAL
    )
    + ") SELECT rule_id, 'true' AS security_alert, count(*) AS n_findings FROM found GROUP BY rule_id",
    "first_match_only": "WITH "
    + PREPARED_SQL
    + ", found AS ("
    + " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id FROM prepared WHERE {gate_sql('norm_dialect', r.dialect_list)} AND regexp_matches(raw, {sql_text(r.pattern)}, 'i')" for r in _plain("cost"))
    + ") SELECT rule_id, count(*) AS n_first FROM found GROUP BY rule_id",
    "rule_stats": f"SELECT dimension, severity, kind, count(*) AS n_rules, sum((n_dialects > 0)::INT)::BIGINT AS n_dialect_rules FROM (VALUES {_stats_values()}) t(rule_id, severity, dimension, kind, n_dialects) GROUP BY ALL",
    "table_rule_stats": "SELECT dimension, severity, kind, count(*) AS n_rules, sum((len(dialects) > 0)::INT)::BIGINT AS n_dialect_rules FROM rules GROUP BY ALL",
}
