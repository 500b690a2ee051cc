"""The whole analysis: sources to statements to findings.

Statements and findings are each written once to the shared folder, since many plans read them.

    from strataql import engine
    done = engine.analyze_path(spark, "/path/to/project")
    done.findings.show(); done.statistics().show()
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.functions.dialects import canonical_dialect, detect_dialect
from strataql.operators import filters, reporting, schema, schema_rules
from strataql.operators.findings import node_findings, pattern_findings, prepare, text_findings
from strataql.operators.fixes import SAFE_REWRITES, rewrite
from strataql.operators.relational import numbered
from strataql.operators.splitting import split_sources, statement_type
from strataql.operators.structure import structured
from strataql.rules import advice, catalog
from strataql.rules.spec import NODE, PATTERN, SEVERITY_WEIGHT, Rule
from strataql.rules.text_rules import CONDITIONS, UNFILTERED_COUNT
from strataql.session import written
from strataql.sources import migrations
from strataql.sources.config import Config
from strataql.sources.extract import extract_sources
from strataql.sources.files import changed_files, only_files, read_sources

#: The rule that no catalogue lists, since an analyzer brings it.
EXTRA = catalog.CustomRule(UNFILTERED_COUNT, "Unfiltered count", "low", "", "text", "", "cost")
_KEY = ["file", "query_index"]
_CARRY = [*_KEY, "line_no", "col_no", "context"]
_FIX = "struct<description:string,replacement:string,is_safe:boolean,confidence:string,original:string>"
_FOUND = [*_CARRY, "rule_id", "ordinal", "snippet", "said", "fix"]


@dataclass(frozen=True)
class Analysis:
    """Statements and findings of a run, both written."""

    statements: DataFrame
    findings: DataFrame
    config: Config

    def statistics(self) -> DataFrame:
        """Findings by severity, zero-filled."""
        return reporting.zero_filled(self.findings, "severity", list(reporting.SEVERITIES))

    def health(self) -> DataFrame:
        return reporting.health(self.findings, ["file"])

    def exit_codes(self, fail_on: str | None = None) -> DataFrame:
        return reporting.exit_codes(self.findings, fail_on or self.config.fail_on)

    def new_against(self, baseline: DataFrame) -> DataFrame:
        return filters.new_findings(self.findings, baseline)

    def overlong(self) -> DataFrame:
        """Statements longer than the configured length; they are analysed like all others."""
        return self.statements.filter(F.length("raw") > self.config.max_query_length).select(*_KEY, F.length("raw").alias("length"))

    def to_json(self, path: str) -> None:
        """The findings as JSON lines, one file a partition."""
        self.findings.write.mode("overwrite").json(path)

    def to_sarif(self, path: str, run: str) -> None:
        """A SARIF log as lines that make one JSON document when read in order: head, results, tail."""
        reporting.sarif_log(self.findings, run).write.mode("overwrite").text(path)

    def fixed(self) -> DataFrame:
        """Each statement that safe fixes change: its keys, its text, and the text after all of them."""
        safe = self.findings.filter("fix.is_safe").select(*_KEY, "rule_id").distinct().groupBy(*_KEY).agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
        after = F.col("raw")
        for rule_id in sorted(SAFE_REWRITES):
            after = F.when(F.array_contains("rules", rule_id), rewrite(after, rule_id)).otherwise(after)
        return self.statements.join(safe, _KEY).select(*_KEY, "raw", after.alias("fixed"), "rules")


def statements_of(sources: DataFrame, config: Config) -> DataFrame:
    """file, query_index, raw, line_no, col_no, is_dynamic, context, dialect, query_type, stmt_id of all statements.

    Scripts are split, code is searched for SQL; sources of other kinds have none. A statement's
    dialect is the configured one or else what its text speaks for. No statement is too long.
    """
    scripts = split_sources(sources.filter("route = 'script'")).select(*_KEY, "raw", "line_no", "col_no", F.lit(False).alias("is_dynamic"))
    code = extract_sources(sources).select(*_KEY, "raw", "line_no", "col_no", "is_dynamic")
    context = filters.source_context(F.col("file"), F.col("content"))
    for pattern, name in config.context_overrides.items():
        context = F.when(F.col("file").rlike(pattern), name).otherwise(context)
    dialect = canonical_dialect(F.lit(config.dialect)) if config.dialect else detect_dialect(F.col("raw"))
    joined = scripts.unionByName(code).join(sources.select("file", context.alias("context")), "file")
    return joined.withColumns({"dialect": dialect, "query_type": statement_type(F.col("raw")), "stmt_id": F.xxhash64("file", "query_index")})


def chosen_rules(config: Config) -> list[Rule]:
    rules = catalog.select([*catalog.all_rules(), EXTRA], config.enabled_rules, config.disabled_rules)
    # Schemas and migrations are compared where there are any, whatever dimensions are asked for.
    return [r for r in rules if r.dimension in (*config.enabled_dimensions, "schema", "migration")]


def _single(statements: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of the rules that look at one statement."""
    ids = {r.rule_id for r in rules}
    ready = prepare(statements)
    extra = {UNFILTERED_COUNT: CONDITIONS[UNFILTERED_COUNT]} if UNFILTERED_COUNT in ids else {}
    nothing = {"said": F.lit(None).cast("string"), "fix": F.lit(None).cast(_FIX)}
    found = pattern_findings(ready, [r for r in rules if r.kind == PATTERN], _CARRY).withColumns(nothing).select(_FOUND)
    texts = text_findings(ready, rules, [*_CARRY, "raw"], extra)
    found = found.unionByName(texts.withColumns({"ordinal": F.lit(0), "snippet": F.col("raw"), **nothing}).select(_FOUND))
    if any(r.kind == NODE for r in rules):
        nodes = node_findings(structured(statements, _CARRY), [*_CARRY, "raw"]).filter(F.col("rule_id").isin(*ids))
        each = nodes.select(*_CARRY, "rule_id", F.explode(F.sequence(F.lit(0), F.col("n_findings") - 1)).alias("ordinal"), F.col("raw").alias("snippet"))
        found = found.unionByName(each.withColumns(nothing).select(_FOUND))
    return found


def _several(found: DataFrame, statements: DataFrame) -> DataFrame:
    """Findings of rules over several statements (scope, seq, ...), with their statement's place."""
    fix = F.when(F.col("f.replacement").isNotNull(), F.struct(F.col("f.fix").alias("description"), F.col("f.replacement").alias("replacement"), F.lit(False).alias("is_safe"), F.lit("probable").alias("confidence"), F.lit("").alias("original")))
    f, s = found.alias("f"), statements.alias("s")
    joined = f.join(s, (F.col("f.scope") == F.col("s.scope")) & (F.col("f.seq") == F.col("s.seq")))
    return joined.select(*[F.col(f"s.{c}").alias(c) for c in _CARRY], F.col("f.rule_id").alias("rule_id"), F.lit(0).alias("ordinal"), F.coalesce("f.snippet", "s.raw").alias("snippet"), F.col("f.message").alias("said"), fix.cast(_FIX).alias("fix"))


def described(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rule's severity, dimension and category, and what the finding says, means and asks for."""
    rows = [(r.rule_id, r.name, r.severity, SEVERITY_WEIGHT[r.severity], r.dimension, r.category, advice.impact(r), advice.remedy(r), r.dialect_list) for r in rules]
    # One row a rule.
    about = F.broadcast(found.sparkSession.createDataFrame(rows, "rule_id string, name string, severity string, severity_weight int, dimension string, category string, impact string, remedy string, tags array<string>"))
    safe = F.lit(None).cast("string")
    for rule_id in SAFE_REWRITES:
        safe = F.when(F.col("rule_id") == rule_id, rewrite(F.col("snippet"), rule_id)).otherwise(safe)
    own = F.when(safe != F.col("snippet"), F.struct(F.col("remedy").alias("description"), safe.alias("replacement"), F.lit(True).alias("is_safe"), F.lit("safe").alias("confidence"), F.col("snippet").alias("original"))).cast(_FIX)
    return (
        found.join(about, "rule_id")
        .withColumns({"message": F.coalesce("said", advice.message(F.col("name"), F.col("snippet"))), "fix": F.coalesce("fix", own), "metadata": F.create_map(F.lit("context"), F.coalesce("context", F.lit("")))})
        .select(*_KEY, "line_no", "col_no", "rule_id", "ordinal", "message", "severity", "severity_weight", "dimension", "category", "snippet", "impact", "remedy", "fix", "tags", "metadata", "context")
    )


def analyze_sources(sources: DataFrame, config: Config | None = None) -> Analysis:
    """All rules over sources (file, content, route).

    findings: file, query_index, line_no, col_no, rule_id, ordinal, message, severity,
    severity_weight, dimension, category, snippet, impact, remedy, fix, tags, metadata.

    The schema is what the sources' own DDL leaves. Files that belong to a migration framework are
    analysed as its chain: in order, each against the schema before it.
    """
    config = config or Config()
    rules = chosen_rules(config)
    ids = [r.rule_id for r in rules]
    chain = written(migrations.statements_of(migrations.migrations(sources)), "migrations")
    plain = sources.join(chain.select("file").distinct(), "file", "left_anti")
    moved = chain.select("file", "scope", "seq", "raw", F.lit(False).alias("is_dynamic"), F.lit("migration").alias("context"))
    moved = moved.withColumns({"dialect": canonical_dialect(F.lit(config.dialect)) if config.dialect else detect_dialect(F.col("raw")), "query_type": statement_type(F.col("raw"))})
    moved = moved.withColumns({"query_index": (F.col("seq") % migrations.STATEMENTS).cast("int"), "stmt_id": F.xxhash64("file", "seq"), "line_no": F.lit(1), "col_no": F.lit(1)})
    # A project's statements are numbered by file and place: the order in which its DDL counts.
    ordered = written(numbered(statements_of(plain, config), _KEY, "seq"), "statements").withColumn("scope", F.lit("project"))
    placed = ordered.drop("seq", "scope")
    every = placed.unionByName(moved.select(*placed.columns))
    # Directives count in scripts; a chain's files have none here.
    found = filters.unsuppressed(written(_single(every, rules), "single"), filters.directives(plain.filter("route = 'script'"), prefix=config.directive_prefix))
    events = migrations.migration_events(chain)
    breaks = schema_rules.migration_findings(events, schema.history(events))
    found = found.unionByName(_several(breaks, moved)).unionByName(_several(schema_rules.project_findings(ordered, "scope", "seq", migrations=False), ordered))
    found = found.filter(F.col("rule_id").isin(*ids)).filter(filters.counts_in_context(F.col("context"), F.col("rule_id")) | F.col("rule_id").isin("MIG-BRK-001"))
    findings = filters.override_severity(described(found, rules), config.severity_overrides).drop("context")
    return Analysis(every, written(findings, "findings"), config)


def analyze(spark: SparkSession, sql: str, config: Config | None = None, file: str = "<stdin>") -> Analysis:
    """One script."""
    return analyze_sources(spark.createDataFrame([(file, sql, "script")], "file string, content string, route string"), config)


def analyze_path(spark: SparkSession, path: str, config: Config | None = None, changed_since: str | None = None) -> Analysis:
    """A file or all files of a folder; with `changed_since` only what git says has changed since."""
    sources = read_sources(spark, path)
    if changed_since:
        sources = only_files(sources, changed_files(path, changed_since))
    return analyze_sources(sources, config)
