"""Statements by which the grammars are measured, written after they were done; README has the figures of the first measurement."""

VALID = [
    ("postgresql", "SELECT * FROM generate_series(1, 10) AS g(n)"),
    ("postgresql", "SELECT a FROM t WHERE b = ANY ($1)"),
    ("postgresql", "INSERT INTO t SELECT * FROM u ON CONFLICT ON CONSTRAINT k DO UPDATE SET a = EXCLUDED.a"),
    ("postgresql", "WITH x AS MATERIALIZED (SELECT 1) DELETE FROM t USING x WHERE t.a = x.a RETURNING *"),
    ("postgresql", "CREATE MATERIALIZED VIEW v AS SELECT 1 WITH NO DATA"),
    ("postgresql", "CREATE TYPE mood AS ENUM ('a', 'b')"),
    ("postgresql", "VACUUM (ANALYZE) t"),
    ("postgresql", "COMMENT ON TABLE t IS 'x'"),
    ("postgresql", "SELECT ROW(1, 2), ARRAY[1, 2][1], a BETWEEN SYMMETRIC 1 AND 2 FROM t"),
    ("postgresql", "SELECT a FROM t FETCH FIRST ROW ONLY"),
    ("mysql", "SELECT SQL_NO_CACHE a FROM t USE INDEX (i) WHERE b <=> NULL"),
    ("mysql", "UPDATE t JOIN u ON t.a = u.a SET t.b = u.b WHERE u.c = 1"),
    ("mysql", "REPLACE INTO t (a) VALUES (1)"),
    ("mysql", "SHOW TABLES LIKE 'x%'"),
    ("mysql", "SELECT GROUP_CONCAT(a ORDER BY b SEPARATOR ',') FROM t"),
    ("mysql", "LOAD DATA INFILE 'x' INTO TABLE t FIELDS TERMINATED BY ','"),
    ("mysql", "CREATE EVENT e ON SCHEDULE EVERY 1 DAY DO DELETE FROM t"),
    ("tsql", "SELECT a FROM t CROSS APPLY OPENJSON(j) WITH (x INT '$.x') AS o"),
    ("tsql", "SELECT a FROM t FOR XML PATH('x')"),
    ("tsql", "UPDATE t SET a += 1 OUTPUT inserted.a WHERE b = 1"),
    ("tsql", "EXEC dbo.p @a = 1, @b = N'x' OUTPUT"),
    ("tsql", "MERGE t AS x USING s AS y ON x.a = y.a WHEN NOT MATCHED BY SOURCE THEN DELETE;"),
    ("tsql", "SELECT TOP 5 WITH TIES a FROM t ORDER BY a"),
    ("tsql", "CREATE OR ALTER VIEW v AS SELECT 1 AS a"),
    ("oracle", "SELECT a FROM t START WITH b IS NULL CONNECT BY PRIOR c = b"),
    ("oracle", "SELECT LISTAGG(a, ',') WITHIN GROUP (ORDER BY a) FROM t"),
    ("oracle", "CREATE SEQUENCE s START WITH 1 INCREMENT BY 1"),
    ("oracle", "SELECT a FROM t WHERE d > DATE '2024-01-01' AND ROWNUM < 5"),
    ("oracle", "BEGIN DBMS_OUTPUT.PUT_LINE('x'); END;"),
    ("oracle", "CREATE OR REPLACE TRIGGER r BEFORE INSERT ON t FOR EACH ROW BEGIN :NEW.a := 1; END;"),
    ("sqlite", "PRAGMA foreign_keys = ON"),
    ("sqlite", "CREATE VIRTUAL TABLE t USING fts5(a, b)"),
    ("sqlite", "INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO UPDATE SET b = excluded.b"),
    ("sqlite", "SELECT a FROM t INDEXED BY i WHERE b GLOB 'x*'"),
    ("snowflake", "SELECT $1, t.$2 FROM @stage/path (FILE_FORMAT => 'f') t"),
    ("snowflake", "CREATE OR REPLACE STAGE s URL = 's3://b/'"),
    ("snowflake", "SELECT a FROM t AT (OFFSET => -60)"),
    ("snowflake", "CREATE TABLE a CLONE b"),
    ("bigquery", "SELECT * EXCEPT (a) REPLACE (b AS c) FROM t"),
    ("bigquery", "SELECT STRUCT(1 AS a, 'x' AS b), ARRAY<INT64>[1, 2] FROM t"),
    ("bigquery", "CREATE TEMP FUNCTION f(x INT64) AS (x + 1); SELECT f(1)"),
    ("bigquery", "SELECT a FROM `p.d.t*` WHERE _TABLE_SUFFIX = '1'"),
    ("redshift", "UNLOAD ('SELECT 1') TO 's3://b/' IAM_ROLE 'r' PARALLEL OFF"),
    ("redshift", "CREATE EXTERNAL TABLE s.t (a int) STORED AS PARQUET LOCATION 's3://b/'"),
    ("redshift", "SELECT a FROM t QUALIFY ROW_NUMBER() OVER (ORDER BY a) = 1"),
]
INVALID = [
    ("postgresql", 'SELECT a b c FROM t'),
    ("postgresql", 'SELECT FROM WHERE'),
    ("postgresql", 'UPDATE t a = 1'),
    ("postgresql", 'INSERT t VALUES (1)'),
    ("mysql", 'SELECT a FROM t WHERE (b = 1'),
    ("mysql", 'DELETE t WHERE'),
    ("mysql", 'SELECT a,, b FROM t'),
    ("tsql", 'SELECT a FROM t ORDER'),
    ("tsql", 'SELECT a FROM t GROUP a'),
    ("oracle", 'SELECT a FROM'),
    ("oracle", 'UPDATE t SET'),
    ("sqlite", 'CREATE TABLE t a int'),
    ("sqlite", "SELECT 'abc FROM t"),
    ("snowflake", 'SELECT a FROM t LIMIT'),
    ("snowflake", 'SELECT CASE WHEN a THEN 1 FROM t'),
    ("bigquery", 'SELECT a FROM t JOIN ON x'),
    ("bigquery", 'def f(x): return x'),
    ("redshift", 'SELECT a FROM t WHERE b IN ()x'),
    ("redshift", '<html><body>x</body></html>'),
    ("postgresql", 'CREATE VIEW v SELECT 1'),
    ("mysql", 'ALTER t ADD a int'),
    ("postgresql", 'GRANT SELECT t TO bob'),
    ("tsql", 'DROP PROC'),
    ("oracle", 'MERGE INTO t USING s WHEN MATCHED THEN DELETE'),
    ("postgresql", 'SELECT count( FROM t'),
]
