from collections import defaultdict

from strataql.llm.canonical import canonical
from strataql.llm.copies import Trie, copy_classes, copy_members

SAME = [
    ("SELECT a, b FROM t WHERE x = 1;", 'select  "B",\r\n [a] from `T` where X = 1 ; ;'),
    ("UPDATE t SET a = 1, b = 'Q' WHERE c = 2", "update t set b='Q',a=1 where c=2;"),
    ("INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y')", "insert into T (b, a) values ('x', 1), ('y', 2);"),
    ("WITH r AS (SELECT a, b FROM t) SELECT b, a FROM r", "with r as (select b,a from t) select a,b from r"),
    ("INSERT INTO t (a, b) SELECT c, d FROM u", "INSERT INTO t (b, a) SELECT d, c FROM u"),
    ("INSERT t (b, a) VALUES (2, 1)", "insert T (a, b) values (1, 2)"),
    ("INSERT TOP (3) dbo.t (b, a) SELECT d, c FROM u", "INSERT TOP (3) dbo.t (a, b) SELECT c, d FROM u"),
    ("INSERT INTO t (a, b) SELECT CASE WHEN c > 1 THEN 2 ELSE 3 END, d FROM u", "INSERT INTO t (b, a) SELECT d, CASE WHEN c > 1 THEN 2 ELSE 3 END FROM u"),
    ("MERGE INTO t USING s ON (t.a = s.a) WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.a, s.b)", "MERGE INTO t USING s ON (t.a = s.a) WHEN NOT MATCHED THEN INSERT (b, a) VALUES (s.b, s.a)"),
    ("MERGE INTO t USING s ON t.a = s.a WHEN NOT MATCHED AND c THEN INSERT (a, b) VALUES (1, 2) WHEN NOT MATCHED THEN INSERT (a, b) VALUES (3, 4)", "MERGE INTO t USING s ON t.a = s.a WHEN NOT MATCHED AND c THEN INSERT (b, a) VALUES (2, 1) WHEN NOT MATCHED THEN INSERT (b, a) VALUES (4, 3)"),
    ("SELECT DISTINCT ON (a) b, c FROM t", "SELECT DISTINCT ON (a) c, b FROM t"),
    ("INSERT INTO t (a, b) VALUES (1, 2) ON CONFLICT (a, b) DO NOTHING", "INSERT INTO t (b, a) VALUES (2, 1) ON CONFLICT (a, b) DO NOTHING"),
]
SAME += [
    ('SELECT "from", a FROM t', 'SELECT a, "from" FROM t'),
    ("SELECT [order], `limit`, b FROM t", 'SELECT b, limit, "order" FROM t'),
    ("SELECT t.offset, a FROM t", "SELECT a, t.offset FROM t"),
    ('UPDATE t SET "where" = 1, a = 2 WHERE c = 3', "UPDATE t SET a = 2, [where] = 1 WHERE c = 3"),
    ("UPDATE t SET a = CASE WHEN b THEN 1 END, c = 2", "UPDATE t SET c = 2, a = CASE WHEN b THEN 1 END"),
    ("INSERT INTO t SET a = 1, b = 2", "INSERT INTO t SET b = 2, a = 1"),
    ('INSERT INTO t (a, "values") VALUES (1, 2) ON CONFLICT (a) DO NOTHING', "INSERT INTO t (`values`, a) VALUES (2, 1) ON CONFLICT (a) DO NOTHING"),
]
DIFFERENT = [
    ("INSERT INTO t (a, b) VALUES (1, 2) ON CONFLICT (a, b) DO NOTHING", "INSERT INTO t (a, b) VALUES (1, 2) ON CONFLICT (b, a) DO NOTHING"),
    ("ALTER TABLE t ALTER a SET DEFAULT 1, ADD b INT", "ALTER TABLE t ADD b INT, ALTER a SET DEFAULT 1"),
    ("SELECT a FROM t WHERE x = 'A'", "SELECT a FROM t WHERE x = 'a'"),
    ("SELECT a FROM t WHERE x = 'a  b'", "SELECT a FROM t WHERE x = 'a b'"),
    ("SELECT a FROM t WHERE x = 1 AND y = 2", "SELECT a FROM t WHERE y = 2 AND x = 1"),
    ("SELECT a FROM t -- note", "SELECT a FROM t"),
    ("SELECT a FROM t ORDER BY a, b", "SELECT a FROM t ORDER BY b, a"),
    ("INSERT INTO t (a, b) VALUES (1, 2)", "INSERT INTO t (b, a) VALUES (1, 2)"),
    ("INSERT t (a, b) SELECT c, d FROM u", "INSERT t (a, b) SELECT d, c FROM u"),
    ("MERGE INTO t USING s ON (t.a = s.a) WHEN NOT MATCHED THEN INSERT (a, b) VALUES (1, 2)", "MERGE INTO t USING s ON (t.a = s.a) WHEN NOT MATCHED THEN INSERT (a, b) VALUES (2, 1)"),
    ("SELECT DISTINCT ON (a) b FROM t", "SELECT DISTINCT ON (b) a FROM t"),
    ("SELECT INSERT(a, 1, 2, 'x') FROM t", "SELECT INSERT(a, 2, 1, 'x') FROM t"),
    ("SELECT a FROM t WHERE x < 1", "SELECT a FROM t WHERE x <= 1"),
]


def test_canonical():
    for a, b in SAME:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in DIFFERENT:
        assert canonical(a) != canonical(b), (a, b)
    assert canonical("  \r\n ;") == ""


def test_trie():
    t = Trie()
    for k, text in enumerate([b"x" * 100, b"x" * 100 + b"y", b"", b"x" * 100]):
        t.add(text, k)
    assert {a: (b, c) for a, b, c in t.items()} == {b"x" * 100: (0, 2), b"x" * 100 + b"y": (1, 1), b"": (2, 1)}


def test_members_by_brute_force(spark):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + [None, "", " \n", ";", "x" * 5000, "X" * 5000] + ["select 1"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "stmt_id long, raw string").selectExpr("*", "'q' AS id", "1 AS digest", "2 AS keep_id")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        if t is not None and canonical(t):
            groups[canonical(t)].append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    for size in (1, 3, 1000):
        assert {tuple(r) for r in copy_members(df, "stmt_id", "raw", bucket_rows=size).collect()} == want
    classes, _ = copy_classes(df, "stmt_id", "raw")
    assert {(r.keep_id, r.n_copies) for r in classes.collect()} == {(min(g), len(g)) for g in groups.values()}


def test_empty(spark):
    df = spark.createDataFrame([], "stmt_id long, raw string")
    assert copy_members(df, "stmt_id", "raw").collect() == []
