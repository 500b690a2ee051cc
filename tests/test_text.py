import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataql.operators import fixes as fx
from strataql.operators import splitting as sp
from strataql.sources import extract as ex
from strataql.sources import files


def test_split():
    text = "-- one; two\nSELECT ';' FROM t;\n\n  UPDATE t SET a = 'it''s; x' -- y;\n;\nCREATE FUNCTION f() AS $b$ x; y $b$;\nBEGIN; SELECT 1; END; SELECT CASE WHEN a THEN 1 END"
    got = sp.split(text)
    assert [g[0].split("\n")[0] for g in got] == ["SELECT ';' FROM t;", "UPDATE t SET a = 'it''s; x' -- y;", "CREATE FUNCTION f() AS $b$ x; y $b$;", "BEGIN; SELECT 1; END;", "SELECT CASE WHEN a THEN 1 END"]
    assert [(g[3], g[4]) for g in got[:2]] == [(2, 1), (4, 3)]
    assert all(text[g[1] : g[2]] == g[0] for g in got)
    assert sp.split("") == sp.split(" -- x\n /* y */ ") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB;'\"-/*\n $`", max_size=40))
def test_split_keeps_order_and_text(text):
    at = 0
    for raw, start, end, line, column in sp.split(text):
        assert text[start:end] == raw and start >= at and line == text.count("\n", 0, start) + 1 and column >= 1
        at = end


def test_templates():
    text = "{# c #}SELECT {% if x %}a{% endif %} FROM {{ ref('t') }} {{x}}"
    out = sp.without_templates(text)
    assert len(out) == len(text) and "{" not in out and "__jinja" in out and out.endswith("xxxxx")


def test_split_sources_and_tokens(spark):
    df = spark.createDataFrame([("a.sql", "SELECT 1; SELECT {{ x;y }};"), ("b.sql", None), ("c.sql", "")], "file string, content string")
    rows = sp.split_sources(df).orderBy("query_index").collect()
    assert [(r.query_index, r.raw) for r in rows] == [(0, "SELECT 1;"), (1, "SELECT {{ x;y }};")]
    stmts = spark.createDataFrame([(1, "SELECT a1, 'x''y' /* c */ FROM \"T\" WHERE b >= 2.5 AND c = ? €"), (2, None), (3, "")], "stmt_id long, raw string")
    found = sp.tokens(stmts, "stmt_id").orderBy("position").collect()
    text = stmts.first().raw
    assert "".join(r.token for r in found) == text and all(text[r.start_offset : r.start_offset + len(r.token)] == r.token for r in found)
    kinds = [(r.token, r.type) for r in sp.significant(sp.tokens(stmts, "stmt_id")).orderBy("position").collect()]
    assert kinds == [("SELECT", "KEYWORD"), ("a1", "IDENTIFIER"), (",", "PUNCTUATION"), ("'x''y'", "STRING"), ("FROM", "KEYWORD"), ('"T"', "QUOTED_NAME"), ("WHERE", "KEYWORD"), ("b", "IDENTIFIER"), (">=", "OPERATOR"), ("2.5", "NUMBER"), ("AND", "KEYWORD"), ("c", "IDENTIFIER"), ("=", "OPERATOR"), ("?", "PLACEHOLDER"), ("€", "UNKNOWN")]
    where = spark.createDataFrame([("a\nbcd", 4)], "t string, o int").select(sp.location(F.col("t"), F.col("o")).alias("p")).first().p
    assert (where.line, where.column) == (2, 3)
    kinds = spark.createDataFrame([("-- x\nWITH a AS (SELECT 1) SELECT 2",), ("drop table x",), (" ",)], "t string").select(sp.statement_type(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["SELECT", "DROP", None]


def test_extract():
    code = 'def f(i):\n    q = f"SELECT * FROM t WHERE id = {i}"\n    return "nothing", """\n  UPDATE t SET a = 1"""\n'
    assert ex.from_python(code) == [("SELECT * FROM t WHERE id = __dynamic__", 2, 9, True), ("UPDATE t SET a = 1", 3, 23, False)]
    assert ex.from_python("def (") == []
    assert ex.from_literals("const q = `SELECT a\nFROM t WHERE x = ${id}`;\nlog('hi')", "typescript") == [("SELECT a\nFROM t WHERE x = ${id}", 1, 11, True)]
    assert ex.from_literals('String q = "DELETE FROM t WHERE a = \\"x\\"";', "java")[0][3] is False
    assert ex.from_literals('db.Exec("SELECT a FROM %s")', "go")[0][3] is True
    xml = """<mapper namespace="m">
  <select id="one">SELECT a FROM t <where><if test="x">AND b = #{b}</if></where> ORDER BY ${col}</select>
  <update id="two">UPDATE t <set>a = #{a},</set> WHERE id = 1</update>
  <insert id="three">INSERT INTO t VALUES (1)</insert>
</mapper>"""
    got = ex.from_mapper(xml)
    assert got == [("SELECT a FROM t WHERE b = ? ORDER BY __DYNAMIC__", 2, 3, True), ("UPDATE t SET a = ? WHERE id = 1", 3, 3, True), ("INSERT INTO t VALUES (1)", 4, 3, False)]
    full = """<mapper><!-- all -->
  <sql id="cols">a, b</sql>
  <select id="x">SELECT <include refid="ns.cols"/> FROM t <where>OR <choose><when test="p">c = 1</when><otherwise>AND d = 2</otherwise></choose></where>
    <trim prefix="AND (" suffix=")" prefixOverrides="AND |OR " suffixOverrides="OR|,">and e IN <foreach collection="es" item="e" open="(" close=")" separator=",">#{e}</foreach> or</trim></select>
  <insert id="y"><selectKey keyProperty="id">SELECT 7</selectKey>INSERT INTO t <set></set>VALUES (#{v})</insert>
</mapper>"""
    assert [(raw, dynamic) for raw, _, _, dynamic in ex.from_mapper(full)] == [("a, b", False), ("SELECT a, b FROM t WHERE c = 1 AND d = 2 AND ( e IN (?) )", True), ("INSERT INTO t VALUES (?)", True)]
    assert ex.from_mapper("<mapper><select id='a'>SELECT a < b FROM t</select>") == [("SELECT a < b FROM t", 1, 9, False)]


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text('q = "SELECT 1"\n')
    (tmp_path / "b.sql").write_text("SELECT 1;\nSELECT 2;")
    (tmp_path / "c.txt").write_text("x")
    src = files.read_sources(spark, str(tmp_path))
    assert {(r.suffix, r.route) for r in src.collect()} == {("py", "python"), ("sql", "script"), ("txt", None)}
    assert [(r.raw, r.line_no) for r in ex.extract_sources(src).collect()] == [("SELECT 1", 1)]
    assert files.only_files(src, ["b.sql"]).count() == 1 and files.only_files(src, []).count() == 0
    with pytest.raises(ValueError):
        files.changed_files(str(tmp_path / "nowhere"))


def test_fixes(spark):
    f = lambda **k: {"rule_id": "r", "description": "d", "original": None, "replacement": "", "start": None, "end": None} | k
    assert fx.apply("abcdef", [f(start=0, end=2, replacement="X"), f(start=4, end=6, original="ef", replacement="Y"), f(start=5, end=6, replacement="no")]) == "Xcdeno"
    assert fx.apply("a b a", [f(original="a", replacement="c")]) == "c b a"
    assert fx.apply("abc", [f(start=1, end=9, replacement="x"), f(start=0, end=1, original="z", replacement="x")]) == "abc"
    assert fx.preview("a\n", "a\n") == "" and "+b" in fx.preview("a\n", "b\n")
    cases = {
        "PERF-LOCK-002": ("SELECT a FROM t WITH (NOLOCK) JOIN u WITH (NOLOCK)", "SELECT a FROM t JOIN u WITH (NOLOCK)"),
        "QUAL-NULL-001": ("x WHERE a = NULL", "x WHERE a IS NULL"),
        "QUAL-MODERN-004": ("SELECT CASE WHEN a THEN 1 END", "SELECT CASE WHEN a THEN 1 ELSE NULL END"),
        "QUAL-STYLE-002": ("WHERE EXISTS (SELECT * FROM t)", "WHERE EXISTS (SELECT 1 FROM t)"),
        "QUAL-TSQL-001": ("SET ANSI_NULLS OFF", "SET ANSI_NULLS ON"),
        "QUAL-MYSQL-003": ("SELECT a LOCK IN SHARE MODE", "SELECT a FOR SHARE"),
        "QUAL-DUCK-001": ("SELECT DATE(x)", "SELECT CAST(x AS DATE)"),
        "QUAL-PG-001": ("DO $$ x $$", "DO $$ x $$ LANGUAGE plpgsql;"),
    }
    for rule, (before, after) in cases.items():
        assert spark.createDataFrame([(before,)], "t string").select(fx.rewrite(F.col("t"), rule).alias("x")).first().x == after, rule
    st_ = spark.createDataFrame([(1, "SELECT a FROM t"), (2, "x"), (3, None)], "stmt_id long, raw string")
    fixes = spark.createDataFrame([(1, "r", "d", "a", "b", None, None), (1, "r", "d", "a", "b", None, None), (9, "r", "d", "a", "b", None, None)], "stmt_id long, rule_id string, description string, original string, replacement string, start int, end int")
    rows = fx.apply_fixes(st_, fixes).collect()
    assert [(r.stmt_id, r.fixed) for r in rows] == [(1, "SELECT b FROM t")] and "-SELECT a" in rows[0].diff
