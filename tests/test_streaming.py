from datetime import datetime

import pytest

from strataql.rules import catalog
from strataql.streaming import versions as v

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, name, batches, schema):
    """A file stream with one micro-batch for each batch."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{k}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_latest_and_diagnostics(spark, tmp_path):
    rows = [("a", 1, "SELECT * FROM t WHERE x LIKE '%q'", T0), ("a", 2, "SELECT 1;\nSELECT a FROM t WHERE x = NULL", T0), ("b", 1, None, T0)]
    df = spark.createDataFrame(rows, v.VERSION)
    rules = [catalog.by_id("PERF-IDX-002"), catalog.by_id("QUAL-NULL-001")]
    got = [(r.uri, r.line_no, r.rule_id) for r in v.diagnostics(df, rules).collect()]
    assert got == [("a", 2, "QUAL-NULL-001")]
    seen = []
    q = v.publish(stream(spark, tmp_path, "s", [rows[:1], rows[1:]], v.VERSION), rules, lambda f, n: seen.append((n, sorted(r.rule_id for r in f.collect()))), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(x for _, r in seen for x in r) == ["PERF-IDX-002", "QUAL-NULL-001"]


def test_watch(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.sql").write_text("SELECT 1;\nSELECT 2;")
    rows = drain(v.watch(spark, str(tmp_path / "w")).select("uri", "content"), tmp_path, "watched").collect()
    assert [(r.uri.endswith("/w/x.sql"), r.content) for r in rows] == [(True, "SELECT 1;\nSELECT 2;")]


def test_dedupe_windows_and_sessions(spark, tmp_path):
    schema = "raw string, rule_id string, key string, ts timestamp"
    one = [("SELECT 1", "R", "k", T0), ("SELECT 1", "R", "k", T0.replace(minute=5))]
    two = [("SELECT 2", "R", "k", T0.replace(hour=3)), ("SELECT 1", "Q", "k", T0.replace(minute=50)), ("late", "R", "k", T0.replace(day=9))]
    src = stream(spark, tmp_path, "d", [one, two], schema)
    assert sorted(r.raw for r in drain(v.new_statements(src), tmp_path, "fresh").collect()) == ["SELECT 1", "SELECT 2", "late"]
    counted = {(r.window_start, r.rule_id): r.n_findings for r in drain(v.findings_per_window(src), tmp_path, "windows").collect()}
    assert counted == {(T0, "R"): 2, (T0, "Q"): 1, (T0.replace(hour=3), "R"): 1}
    slid = {(r.window_start, r.rule_id): r.n_findings for r in drain(v.findings_per_window(src, "1 hour", "1 day", "30 minutes"), tmp_path, "slides").collect()}
    assert slid[T0, "R"] == 2 and slid[T0.replace(minute=30), "Q"] == 1
    assert sorted(r.n_events for r in drain(v.sessions(src), tmp_path, "sess").collect()) == [1, 1, 2]


@pytest.mark.parametrize("operator", [v.trends_without_rocksdb, v.trends])
def test_trend_state(spark, tmp_path, operator):
    schema = "raw string, ts timestamp"
    src = stream(spark, tmp_path, operator.__name__, [[("SELECT a FROM t", T0), (None, T0)], [("select  a FROM t", T0.replace(hour=1)), ("SELECT COUNT(*) FROM t", T0)]], schema)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        if operator is v.trends:
            pytest.importorskip("google.protobuf")
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        rows = drain(operator(src), tmp_path, operator.__name__).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted((r.score, r.trend is None) for r in rows) == [(10, False), (10, True), (15, True)]
