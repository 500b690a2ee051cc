import json

from strataql import engine
from strataql.operators import filters
from strataql.operators.relational import numbered
from strataql.rules import advice, catalog
from strataql.sources.config import Config

P = filters.DIRECTIVE_PREFIX

#: Files of a project by context, each with all rules that find something in it, and how often.
PROJECT = {
    "migrations/001_people.sql": (
        "CREATE TABLE people (\n  id SERIAL PRIMARY KEY,\n  mail VARCHAR(80) NOT NULL,\n  made TIMESTAMP\n);\nINSERT INTO people (mail) VALUES ('root@here.test');\n",
        "migration", {"REL-IDEM-001": 1},
    ),
    "migrations/002_bills.sql": ("CREATE TABLE bills (\n  id SERIAL PRIMARY KEY,\n  people_id INTEGER REFERENCES people(id),\n  total DECIMAL(10,2)\n);\n", "migration", {}),
    "tests/test_reads.sql": ("SELECT * FROM people WHERE mail = 'a@b.test';\nDELETE FROM people WHERE mail = 'a@b.test';\nSELECT COUNT(*) FROM bills;\n", "test", {}),
    "seeds/rows.sql": ("INSERT INTO people (mail) VALUES\n  ('x@y.test'), ('z@y.test');\nINSERT INTO bills (user_id, total) VALUES\n  (1, 9.5);\n", "seed", {"REL-IDEM-001": 2, "REL-FK-001": 1}),
    "models/recent.sql": ("SELECT * FROM {{ ref('people') }} WHERE made > '2024-01-01'\n", "dbt_model", {"PERF-SCAN-001": 1, "QUAL-MODERN-002": 1}),
    "src/db/reads.sql": (
        "SELECT * FROM orders\nLEFT JOIN bills ON bills.id = orders.id\nWHERE orders.made > '2024-01-01';\nSELECT mail, id FROM people WHERE mail = ?;\n", "application",
        {"PERF-SCAN-001": 1, "PERF-SCAN-003": 2, "SEC-AUTHZ-003": 1, "QUAL-MODERN-002": 1, "COST-IDX-003": 1, "SCHEMA-TBL-001": 1, "SCHEMA-IDX-001": 1},
    ),
    "schema.sql": ("CREATE TABLE audit_log (\n  id SERIAL PRIMARY KEY,\n  what VARCHAR(20)\n);\n", "ddl_schema", {"COMP-RET-001": 1}),
    "scripts/clean.sql": (
        f"-- {P}-disable-next-line PERF\nDELETE FROM bills WHERE total < 5;\nDELETE FROM bills WHERE total < 7;\n", "adhoc",
        {"PERF-BATCH-001": 1, "REL-DEAD-002": 2, "QUAL-DEAD-003": 1, "SCHEMA-IDX-001": 2},
    ),
}
CODE = 'def f(x):\n    return db.run(f"SELECT name FROM t WHERE id = {x}")\n'


def made(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_project(spark, tmp_path):
    path = made(tmp_path / "p", {k: v[0] for k, v in PROJECT.items()} | {"app.py": CODE})
    done = engine.analyze_path(spark, path)
    rows = [r.asDict(True) | {"file": r.file.removeprefix(f"{path}/")} for r in done.findings.collect()]
    by = {}
    for r in rows:
        by.setdefault(r["file"], {}).setdefault(r["rule_id"], []).append(r["line_no"])
    assert {k: {rule: len(lines) for rule, lines in by.get(k, {}).items()} for k in PROJECT} == {k: v[2] for k, v in PROJECT.items()}
    clean = by["scripts/clean.sql"]
    assert clean["PERF-BATCH-001"] == [3] and sorted(clean["REL-DEAD-002"]) == [2, 3] and clean["QUAL-DEAD-003"] == [3]
    contexts = {r.file.removeprefix(f"{path}/"): r.context for r in done.statements.collect()}
    assert contexts == {k: v[1] for k, v in PROJECT.items()} | {"app.py": "application"}
    assert all(r["message"] and r["impact"] and r["remedy"] and r["category"] and r["dimension"] and r["col_no"] >= 1 for r in rows)
    index = next(r for r in rows if r["rule_id"] == "SCHEMA-IDX-001" and r["file"] == "src/db/reads.sql")
    assert index["fix"]["replacement"] == "CREATE INDEX idx_people_mail ON people(mail);" and not index["fix"]["is_safe"] and index["metadata"] == {"context": "application"}
    stats = {r.severity: r.n_findings for r in done.statistics().collect()}
    assert set(stats) == {"critical", "high", "medium", "low", "info"} and sum(stats.values()) == len(rows)
    assert done.exit_codes().first().fail_code == 2
    assert done.new_against(filters.baseline(done.findings)).count() == 0

    filters.save_baseline(filters.baseline(done.findings), str(tmp_path / "base"))
    assert done.new_against(filters.load_baseline(spark, str(tmp_path / "base"))).count() == 0
    done.to_json(str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == len(rows)
    done.to_sarif(str(tmp_path / "sarif"), "strataql")
    log = json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "sarif").glob("part-*"))))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == len(rows)
    assert {r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]} == {r["rule_id"] for r in rows} == {r["ruleId"] for r in log["runs"][0]["results"]}


def test_migration_chain(spark, tmp_path):
    head = "revision = '{}'\ndown_revision = {}\ndef upgrade():\n    {}\n"
    path = made(tmp_path, {
        "alembic/versions/b.py": head.format("a1", "'z9'", "op.drop_column('t', 'n')"),
        "alembic/versions/a.py": head.format("z9", "None", "op.create_table('t', sa.Column('n', sa.Integer()))"),
        "db/V1__x.sql": "CREATE TABLE k (a INT);\nDROP TABLE k;\nDROP TABLE never_made;",
    })
    found = engine.analyze_path(spark, path).findings.filter("rule_id = 'MIG-BRK-001'").collect()
    assert {(r.file.removeprefix(f"{path}/"), r.snippet, r.severity, r.dimension) for r in found} == {("alembic/versions/b.py", "n", "high", "migration"), ("db/V1__x.sql", "k", "high", "migration")}


def test_settings(spark):
    only = engine.analyze(spark, "SELECT * FROM t WHERE x = NULL", Config(enabled_rules=("QUAL-NULL", "PERF-SCAN-001"), severity_overrides={"PERF-SCAN-001": "info"}))
    found = {r.rule_id: r for r in only.findings.collect()}
    assert {k: r.severity for k, r in found.items()} == {"QUAL-NULL-001": "high", "PERF-SCAN-001": "info"}
    assert found["QUAL-NULL-001"].fix.is_safe and found["QUAL-NULL-001"].message.startswith(catalog.by_id("QUAL-NULL-001").name)
    assert [(r.raw, r.fixed, r.rules) for r in only.fixed().collect()] == [("SELECT * FROM t WHERE x = NULL", "SELECT * FROM t WHERE x IS NULL", ["QUAL-NULL-001"])]
    assert engine.analyze(spark, "", Config()).findings.count() == 0
    long = engine.analyze(spark, "SELECT 1 + 1 FROM t", Config(max_query_length=5, context_overrides={"stdin": "test"}))
    assert long.overlong().collect()[0].length == 19 and long.statements.first().context == "test" and long.findings.count() == 0


def test_advice_and_numbers(spark):
    assert all(advice.impact(r) and advice.remedy(r) for r in catalog.all_rules())
    assert advice.explain(catalog.by_id("SEC-CMD-001"))["dialects"] == "tsql"
    df = spark.createDataFrame([(i * 7919 % 500, "x") for i in range(500)], "k long, n_part string")
    assert {(r.k + 1, r.n) for r in numbered(df, ["k"], "n").collect()} == {(i, i) for i in range(1, 501)}
    assert numbered(df.limit(0), ["k"], "n").collect() == []
