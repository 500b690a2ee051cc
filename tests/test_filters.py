from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataql.functions.registry import RuleRegistry, register
from strataql.operators import filters, reporting
from strataql.operators.findings import prepare
from strataql.rules.catalog import load_rules
from strataql.sources import config

P = filters.DIRECTIVE_PREFIX


def test_contexts(spark):
    rows = [
        ("db/migrations/1.sql", None, "migration"), ("tests/models/a.sql", None, "test"), ("models/test.sql", None, "dbt_model"), ("a/my_test.sql", None, "test"), ("seeds/x.sql", None, "seed"),
        ("schema.sql", None, "ddl_schema"), ("src\\x.sql", None, "application"), ("x.py", None, "application"), ("x.sql", "-- flyway", "migration"), ("x.sql", "create or replace view v as", "view_def"),
        (None, "CREATE FUNCTION f", "stored_proc"), (None, None, "adhoc"), ("x.sql", "SELECT {{ ref('a') }}", "dbt_model"),
    ]
    df = spark.createDataFrame(rows, "file string, content string, want string")
    assert [r.got for r in df.select(filters.source_context(F.col("file"), F.col("content")).alias("got")).collect()] == [r[2] for r in rows]
    pairs = [("migration", "SEC-A-1", True), ("migration", "PERF-A-1", False), ("migration", "SEC-INJ-005", False), ("ddl_schema", "COMP-A-1", True), ("adhoc", "PERF-A-1", True), ("adhoc", "QUAL-DBT-001", False), ("dbt_model", "QUAL-DBT-001", True), (None, "PERF-A-1", True)]
    got = spark.createDataFrame(pairs, "c string, r string, want boolean").select(filters.counts_in_context(F.col("c"), F.col("r")).alias("got"))
    assert [r.got for r in got.collect()] == [p[2] for p in pairs]


SOURCE = f"""SELECT 1; -- {P}-disable-line PERF-A, SEC
-- {P}-disable-next-line

-- note
SELECT 2;
-- {P}-disable QUAL
SELECT 3;
SELECT '-- {P}-disable-file';
-- {P}-enable QUAL
SELECT 4;
-- {P}-disable COST-X-001
SELECT 5;"""


def test_suppressions(spark):
    src = spark.createDataFrame([("a", SOURCE), ("b", f"x -- {P}-disable-file REL"), ("c", None), ("d", "")], "file string, content string")
    found = {(r.file, r.scope, r.start_line, r.end_line, r.rule_prefix) for r in filters.directives(src).collect()}
    assert found == {("a", "line", 1, 1, "PERF-A"), ("a", "line", 1, 1, "SEC"), ("a", "line", 5, 5, None), ("a", "block", 7, 8, "QUAL"), ("a", "block", 12, None, "COST-X-001"), ("b", "file", 1, None, "REL")}
    issues = [("a", 1, "PERF-A-001", False), ("a", 1, "PERF-AB-001", True), ("a", 1, "sec-x-1", False), ("a", 5, "ANY-1-1", False), ("a", 7, "QUAL-1-1", False), ("a", 9, "QUAL-1-1", True), ("a", 99, "COST-X-001", False), ("a", 99, "COST-X-002", True), ("b", 5, "REL-1-1", False), ("b", 0, "REL-1-1", True), (None, 1, "REL-1-1", True)]
    df = spark.createDataFrame(issues, "file string, line_no int, rule_id string, stays boolean")
    left = filters.unsuppressed(df, filters.directives(src)).collect()
    assert len(left) == 5 and all(r.stays for r in left)


def test_baseline_and_overrides(spark):
    df = spark.createDataFrame([("R-1", "f", "a  b"), ("R-1", "f", "a b"), ("R-1", None, "x"), ("R-2", "f", "a b"), ("R-3", "f", None)], "rule_id string, file string, snippet string").withColumn("severity", F.lit("low"))
    known = filters.baseline(df.filter("rule_id = 'R-1'"))
    assert known.count() == 2 and len(known.first().fingerprint) == 16
    assert sorted(r.rule_id for r in filters.new_findings(df, known).collect()) == ["R-2", "R-3"]
    assert {(r.rule_id, r.severity) for r in filters.override_severity(df, {"R-1": "high"}).collect()} == {("R-1", "high"), ("R-2", "low"), ("R-3", "low")}
    assert filters.new_findings(df.limit(0), known).collect() == []
    keep = df.filter(filters.allowed(F.col("rule_id"), [], ["R-1"])).select("rule_id").distinct().collect()
    assert sorted(r.rule_id for r in keep) == ["R-2", "R-3"]


def test_reports(spark):
    df = spark.createDataFrame([(1, 1, "A-1", "critical", "security"), (2, 1, "A-1", "high", "security"), (3, None, "B-1", "low", "cost"), (4, 2, "B-1", "odd", "cost")], "issue_id long, stmt_id long, rule_id string, severity string, dimension string")
    assert {r.severity: r.n_findings for r in reporting.zero_filled(df, "severity", list(reporting.SEVERITIES)).collect()} == {"critical": 1, "high": 1, "medium": 0, "low": 1, "info": 0}
    assert {r.dimension: r.health for r in reporting.health(df, ["dimension"]).collect()} == {"security": 60, "cost": 98}
    assert tuple(reporting.exit_codes(df).first()) == (3, 2) and tuple(reporting.exit_codes(df.limit(0)).first()) == (0, 0)
    st = spark.createDataFrame([(1, "SELECT a FROM t JOIN u ON 1 = 1"), (2, "SELECT COUNT(*) FROM (SELECT 1)"), (3, None)], "stmt_id long, raw string")
    assert {r.stmt_id: r.score for r in reporting.complexity(st, df).collect()} == {1: 60, 2: 30, 3: 0}  # 10 + 10 + 25 + 15
    days = [datetime(2024, 1, d) for d in (1, 1, 5, 9)]
    t = spark.createDataFrame([("q", days[0], 1, 10), ("q", days[1], 2, 25), ("q", days[3], 3, 20), ("q", None, 4, 1), ("p", days[2], 5, 5)], "q string, at timestamp, k int, score int")
    assert {r.k: r.trend for r in reporting.trend(t, "q", "at", ["k"]).collect()} == {4: None, 1: 9, 2: 15, 3: -5, 5: None}
    line = df.limit(1).select(reporting.annotation(F.lit("high"), F.lit("a,b:c"), F.lit(3), F.lit(4), F.lit("R"), F.lit("x%\ny")).alias("l"), reporting.csv_line(F.lit('a"b'), F.lit(None), F.lit(3)).alias("c"), reporting.html_row(F.lit("<a>")).alias("h")).first()
    assert line.l == "::error file=a%2Cb%3Ac,line=3,col=4::R x%25%0Ay" and line.c == '"a""b",,3' and line.h == "<tr><td>&lt;a&gt;</td></tr>"
    assert {tuple(r) for r in reporting.heat_map(df).collect()} == {("security", 1, 1, 0, 0), ("cost", 0, 0, 0, 1)}


def test_registry(spark, tmp_path: Path):
    reg = RuleRegistry()
    assert reg.add("MY-1", lambda: F.col("raw").contains("a")) and not reg.add("MY-1", lambda: F.lit(True))
    reg.add("MY-2", lambda t: [w for w in t.split() if w.startswith("x")], as_text=True)
    (tmp_path / "r.json").write_text('{"id": "MY-3", "pattern": "q"}')
    (tmp_path / "p.py").write_text("from pyspark.sql import functions as F\nRULES = {'MY-4': lambda: F.length('raw') > 5}\n")
    assert reg.load(str(tmp_path)) == 2 and "MY-3" in reg and load_rules("[]") == []
    ready = prepare(spark.createDataFrame([(1, "a x1 x2"), (2, "b")], "stmt_id long, raw string").withColumn("dialect", F.lit(None).cast("string")))
    assert sorted((r.stmt_id, r.rule_id, r.snippet) for r in reg.findings(ready, "stmt_id").collect()) == [(1, "MY-1", "a x1 x2"), (1, "MY-2", "x1"), (1, "MY-2", "x2"), (1, "MY-4", "a x1 x2")]
    assert RuleRegistry().findings(ready, "stmt_id").collect() == []
    register(spark)
    assert spark.sql("SELECT strip_templates('{{ a }}') AS t").first().t == "x" * 7
    assert [r.raw for r in spark.sql("SELECT raw FROM split_sql('SELECT 1; SELECT 2')").collect()] == ["SELECT 1;", "SELECT 2"]


def test_config(tmp_path: Path, monkeypatch):
    (tmp_path / "a").mkdir()
    (tmp_path / "strataql.toml").write_text('disabled_rules = ["X-1"]\nmax_query_length = 5\n')
    got = config.find(tmp_path / "a")
    assert got.disabled_rules == ("X-1",) and got.max_query_length == 5 and got.digest != config.Config().digest
    assert config.parse('{"dialect": "mysql"}', ".json").dialect == "mysql"
    assert config.parse('[tool.strataql]\nfail_on = "low"\n', ".toml", "tool.strataql").fail_on == "low"
    with pytest.raises(ValueError):
        config.parse('{"nope": 1}', ".json")
    monkeypatch.setenv("STRATAQL_ENABLED_RULES", "A, B")
    monkeypatch.setenv("STRATAQL_MAX_QUERY_LENGTH", "7")
    env = config.from_env()
    assert env.enabled_rules == ("A", "B") and env.max_query_length == 7
