import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strataql.functions.dialects import canonical_dialect, detect_dialect
from strataql.functions.registry import Analyzer, AnalyzerRegistry, builtin_analyzers
from strataql.operators.findings import pattern_findings, prepare, with_rule_columns
from strataql.operators.structure import frames
from strataql.plans import corpus
from strataql.plans import rules as plans
from strataql.rules import catalog
from strataql.rules.node_rules import FRAME_RULES
from strataql.rules.spec import PATTERN
from strataql.rules.text_rules import CONDITIONS, UNFILTERED_COUNT

PAIRS = corpus.PAIRS
WHOLE = {r.rule_id for r in catalog.all_rules() if r.kind == "schema"} | {"QUAL-DEAD-001", "QUAL-DEAD-002", "QUAL-DEAD-003"}


def test_every_rule_bites(spark):
    """Patterns, texts, structure, projects and schemas, each on a text of its own and not on a near one."""
    got = {r.rule_id: (r.n_firing, r.n_silent) for r in plans.rules_corpus(spark, "").collect()}
    assert set(got) == {r.rule_id for r in catalog.all_rules()} | {UNFILTERED_COUNT}
    assert {k: v for k, v in got.items() if v != (1, 1)} == {}


def test_catalogue():
    rules = catalog.all_rules()
    assert len(rules) == len({r.rule_id for r in rules}) == 283
    covered = set(FRAME_RULES) | set(CONDITIONS)
    assert {r.rule_id for r in rules if r.kind in ("node", "text")} - covered - {"QUAL-DEAD-001", "QUAL-DEAD-002", "QUAL-DEAD-003"} == {r for r in _statement_ids()}
    assert [r.rule_id for r in catalog.select(rules, ["SEC-AUTH"], ["SEC-AUTH-002"])] == ["SEC-AUTH-001", "SEC-AUTH-005", "SEC-AUTH-003", "SEC-AUTH-004"]
    assert catalog.by_id("SEC-AUTH-001").severity == "high" and catalog.by_id("x") is None and catalog.search("nolock")


def _statement_ids():
    source = open(catalog.__file__.replace("catalog.py", "node_rules.py")).read()
    return set(re.findall(r'^        "([A-Z]+-[A-Z]+-\d+)":', source, re.M))


def test_patterns_by_brute_force(spark):
    texts = [t for *_, t in corpus.rows()]
    rules = [r for r in catalog.all_rules() if r.kind == PATTERN and not r.dialects]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "stmt_id long, raw string, dialect string")
    got = sorted((r.stmt_id, r.rule_id, r.snippet) for r in pattern_findings(prepare(df), rules, ["stmt_id"]).collect())
    want = sorted((i, r.rule_id, m.group()) for i, t in enumerate(texts) for r in rules for m in re.finditer(r.pattern, t, re.I))
    assert got == want


def test_structure_takes_linear_time():
    began = time.perf_counter()
    wide = frames("SELECT " + ", ".join(f"f(c{i})" for i in range(20_000)) + " FROM t WHERE a IN (" + ", ".join(map(str, range(50_000))) + ")")[0]
    deep = frames("SELECT a FROM t WHERE " + "f(" * 20_000 + "b" + ")" * 20_000)[0]
    assert wide["n_projections"] == 20_000 and wide["max_in"] == 50_000 and deep["where_func"]
    assert time.perf_counter() - began < 5


def test_custom_rules_and_dialects(spark):
    rules = catalog.load_rules('{"rules": [{"id": "MY-1", "pattern": "foo\\\\d", "severity": "HIGH", "dimension": "cost", "dialects": ["mysql"]}, {"id": "MY-2", "pattern": "bar"}]}')
    df = spark.createDataFrame([(1, "foo1 FOO2 bar", "MariaDB"), (2, "foo1", None), (3, None, "mysql")], "stmt_id long, raw string, dialect string")
    got = with_rule_columns(pattern_findings(prepare(df), rules, ["stmt_id"]), rules).collect()
    assert sorted((r.stmt_id, r.rule_id, r.ordinal, r.snippet, r.severity, r.dimension) for r in got) == [(1, "MY-1", 0, "foo1", "high", "cost"), (1, "MY-1", 1, "FOO2", "high", "cost"), (1, "MY-2", 0, "bar", "medium", "quality")]
    assert catalog.load_rules("") == [] and pytest.raises(ValueError, catalog.load_rules, '[{"id": "x"}]')
    names = spark.createDataFrame([(" T-SQL ",), ("PG",), ("",), (None,), ("x",)], "d string").select(canonical_dialect(F.col("d")).alias("d"))
    assert [r.d for r in names.collect()] == ["tsql", "postgresql", None, None, "x"]
    votes = spark.createDataFrame([("SELECT a::int",), ("SELECT [a]",), ("SELECT `a`",), ("SELECT 1",), ("`p`.`q`",)], "t string").select(detect_dialect(F.col("t")).alias("d"))
    assert [r.d for r in votes.collect()] == ["postgresql", "tsql", "mysql", None, "bigquery"]
    assert pattern_findings(prepare(df), [], ["stmt_id"]).collect() == [] and pattern_findings(prepare(df.limit(0)), rules, ["stmt_id"]).collect() == []


def test_analyzers(spark):
    found = builtin_analyzers()
    assert [a.name for a in found.all()][:2] == ["security", "performance"] and len(found) == 6 and "cost" in found
    with pytest.raises(ValueError):
        found.register(found.get("cost"))
    found.register(replace(found.get("cost"), enabled=False), override=True)
    found.register(Analyzer("own", "quality", lambda df, carry: df.filter(F.col("raw_upper").contains("ODD")).withColumn("rule_id", F.lit("OWN-1")), priority=1))
    assert [a.name for a in found.all("quality")] == ["own", "quality"] and found.stats() == {"analyzers": 7, "enabled": 6, "dimensions": 6}
    ready = prepare(spark.createDataFrame([(1, "SELECT odd FROM t WHERE x = NULL", None)], "stmt_id long, raw string, dialect string"))
    got = {(r.rule_id, r.analyzer) for r in found.findings(ready, ["stmt_id"]).collect()}
    assert {("OWN-1", "own"), ("QUAL-NULL-001", "quality")} <= got and not any(a == "cost" for _, a in got)
    assert found.unregister("own").name == "own" and found.get("own") is None and AnalyzerRegistry().findings(ready, ["stmt_id"]) is None
