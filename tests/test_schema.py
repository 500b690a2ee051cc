import pytest

from strataql.operators import project, schema
from strataql.operators.schema_rules import project_findings
from strataql.sources import migrations as mg

DDL = [
    (1, "CREATE TABLE users (id SERIAL PRIMARY KEY, email VARCHAR(255) NOT NULL UNIQUE, made TIMESTAMPTZ DEFAULT now(), tags TEXT[], x INT REFERENCES other(oid))"),
    (2, "CREATE TABLE app.orders (id INT, user_id INTEGER NOT NULL, total DECIMAL(10, 2), PRIMARY KEY (id), FOREIGN KEY (user_id) REFERENCES users(id), INDEX ix_t (total))"),
    (3, "CREATE UNIQUE INDEX ix_e ON users USING btree (email)"),
    (4, "CREATE VIEW v AS SELECT a FROM users u JOIN orders o ON 1 = 1"),
    (5, "ALTER TABLE users ADD COLUMN age INT, DROP COLUMN tags"),
    (6, "DROP TABLE IF EXISTS orders"),
    (7, "CREATE TABLE orders (id BIGINT)"),
    (8, "CREATE PROCEDURE p() AS BEGIN CALL q(); END"),
    (9, "SELECT drop_table FROM create_table"),
    (10, None),
    (11, "CREATE TABLE"),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([("r", s, t) for s, t in DDL], "scope string, seq long, raw string")
    return schema.ddl_events(df, "scope", "seq")


def test_columns(found):
    cols = {(r.table_name, r.name, r.seq): r for r in found.filter("kind = 'column' AND action = 'create'").collect()}
    u = cols["users", "id", 1]
    assert (u.type, u.nullable, u.primary_key) == ("INTEGER", False, True)
    e = cols["users", "email", 1]
    assert (e.type, e.nullable, e.is_unique) == ("VARCHAR", False, True)
    assert cols["users", "made", 1].type == "TIMESTAMP" and cols["users", "made", 1].default_text == "now"
    assert cols["users", "tags", 1].type == "ARRAY" and cols["users", "x", 1].foreign_key == "other.oid"
    o = cols["orders", "user_id", 2]
    assert o.foreign_key == "users.id" and o.nullable is False and cols["orders", "id", 2].primary_key
    assert cols["orders", "total", 2].type == "DECIMAL"


def test_history_and_rules(spark, found):
    h = schema.history(found)
    now = {(r.kind, r.table_name, r.name) for r in schema.current(h).collect()}
    assert ("column", "users", "age") in now and ("column", "users", "tags") not in now
    assert ("column", "orders", "id") in now and ("column", "orders", "total") not in now and ("index", "orders", "ix_t") not in now
    assert ("view", "v", "v") in now and ("procedure", "p", "p") in now
    before = {(r.kind, r.name) for r in schema.as_of(h, 5).collect()}
    assert ("column", "tags") in before and ("column", "age") not in before
    broken = {(r.seq, r.kind, r.table_name, r.name) for r in schema.breaking_changes(found, h).collect()}
    assert broken == {(5, "column", "users", "tags"), (6, "table", "orders", "orders")}
    cur = schema.current(h)
    uses = spark.createDataFrame([("r", 1, "Users"), ("r", 2, "nowhere"), ("s", 3, "users")], "scope string, key long, table_name string")
    assert {(r.scope, r.table_name) for r in schema.missing_tables(uses, cur.filter("kind = 'table'")).collect()} == {("r", "nowhere"), ("s", "users")}
    assert schema.history(found.limit(0)).collect() == []


READS = [
    (20, "SELECT email FROM Users WHERE email = 'x'", set()),
    (21, "SELECT email FROM nowhere", {("SCHEMA-TBL-001", "nowhere")}),
    (22, "SELECT users.nope, u.nope, nada, x AS y FROM users u", {("SCHEMA-COL-001", "users.nope"), ("SCHEMA-COL-001", "nada")}),
    (23, "SELECT nada FROM (SELECT id FROM users) q", set()),
    (24, "WITH q AS (SELECT id FROM users) SELECT nada FROM q", set()),
    (25, "SELECT email FROM users u WHERE u.age > 3 AND id = 1", {("SCHEMA-IDX-001", "age")}),
    (26, "SELECT u.email FROM users u JOIN orders o ON o.id = u.id WHERE age = 3 AND o.id = 5", {("SCHEMA-IDX-001", "id")}),
    (27, "UPDATE users SET age = 3 WHERE x ->> 'k' = 'v'", {("SCHEMA-IDX-001", "x")}),
    (28, None, set()),
]


def test_reads_against_the_schema(spark):
    rows = [("r", s, t) for s, t in DDL] + [(scope, s, t) for scope in ("r", "bare") for s, t, _ in READS]
    df = spark.createDataFrame(rows, "repo string, at long, body string").selectExpr("*", "'z' AS scope", "1 AS seq", "'z' AS raw")
    got = {(r.scope, r.seq, r.rule_id, r.snippet): r for r in project_findings(df, "repo", "at", "body").collect() if r.rule_id[:7] == "SCHEMA-" and r.seq >= 20}
    assert set(got) == {("r", s, *w) for s, _, want in READS for w in want}
    assert got["r", 25, "SCHEMA-IDX-001", "age"].replacement == "CREATE INDEX idx_users_age ON users(age);"
    assert got["r", 27, "SCHEMA-IDX-001", "x"].replacement == "CREATE INDEX idx_users_x_gin ON users USING GIN (x);"
    assert project_findings(df.limit(0), "repo", "at", "body").collect() == []


def test_project_rules(spark):
    rows = [
        (1, "CREATE VIEW unused_v AS SELECT 1"), (2, "CREATE VIEW used_v AS SELECT 1"), (3, "SELECT * FROM Used_V WHERE a = 1"), (4, "SELECT * FROM  Used_V WHERE a = 2"),
        (5, "SELECT * FROM used_v WHERE a = 2"), (6, None), (7, "CREATE PROCEDURE p() BEGIN SELECT 1; RETURN 1; UPDATE t SET a = 1; END"), (8, "SELECT * FROM Used_V WHERE a = 'x'"),
    ]
    df = spark.createDataFrame(rows, "stmt_id long, raw string").selectExpr("*", "1 AS repo")
    assert {(r.stmt_id, r.name) for r in project.unused_objects(df, ["repo"]).collect()} == {(1, "UNUSED_V"), (7, "P")}
    assert {(r.stmt_id, r.n_copies) for r in project.duplicates(df, ["stmt_id"]).collect()} == {(4, 3), (8, 3)}
    assert [(r.stmt_id, r.snippet) for r in project.unreachable_code(df).collect()] == [(7, "UPDATE t SET a = 1;")]
    drops = spark.createDataFrame([("r", 1, "T", None), ("r", 2, "t", "a"), ("r", 3, "t", "zz")], "scope string, key long, table_name string, column_name string")
    uses = spark.createDataFrame([("r", 1, "t", ["a"]), ("r", 9, "t", ["A", "b"]), ("q", 10, "t", ["a"])], "scope string, key long, table_name string, columns array<string>")
    assert {(r.key, r.n_uses) for r in project.cross_file_breaks(drops, uses).collect()} == {(1, 1), (2, 2)}


MIGRATIONS = [
    ("fly/V10__b.sql", "DROP TABLE t"), ("fly/V2__a.sql", "CREATE TABLE t (a INT)"), ("fly/readme.md", "x"),
    ("liq/c.sql", "--liquibase formatted sql\n--changeset bob:1\nCREATE TABLE a (x INT);\n--changeset bob:2\nDROP TABLE a;\n"),
    ("prj/migrations/2024_b/migration.sql", "DROP TABLE z"), ("prj/migrations/2023_a/migration.sql", "CREATE TABLE z (a INT)"),
    ("alb/versions/1_x.py", "revision = 'z1'\ndown_revision = None\ndef upgrade():\n    op.create_table('users', sa.Column('id', sa.Integer()), sa.Column('n', sa.String()))\n    op.create_index('ix', 'users', ['n'])\n"),
    ("alb/versions/2_y.py", "revision = 'a2'\ndown_revision = 'z1'\ndef upgrade():\n    op.drop_column('users', 'n')\n    op.add_column('users', sa.Column('m', sa.Integer()))\n    op.execute('DROP TABLE users')\n"),
    ("dj/migrations/0001_initial.py", "class Migration(m.Migration):\n    dependencies = [('x', '0000')]\n    operations = [m.CreateModel(name='Item', fields=[('id', f()), ('n', f())]), m.RunSQL('SELECT 1')]\n"),
    ("dj/migrations/0002_more.py", "class Migration(m.Migration):\n    operations = [m.RemoveField(model_name='Item', name='n'), m.AddField('Item', 'k', f()), m.DeleteModel(name='Item')]\n"),
    ("bad.py", "def ("), ("empty.sql", ""), ("none.sql", None),
]


def test_migrations(spark):
    df = spark.createDataFrame(MIGRATIONS, "file string, content string")
    got = {(r.framework, r.seq): r for r in mg.migrations(df).collect()}
    assert {k: got[k].version for k in got} == {("flyway", 1): "2", ("flyway", 2): "10", ("liquibase", 1): "c_0_1", ("liquibase", 2): "c_1_2", ("prisma", 1): "2023_a", ("prisma", 2): "2024_b", ("alembic", 1): "z1", ("alembic", 2): "a2", ("django", 1): "0001_initial", ("django", 2): "0002_more"}
    assert got["alembic", 1].content == "CREATE TABLE users (id INTEGER, n VARCHAR);\nCREATE INDEX ix ON users (n);" and got["alembic", 2].depends_on == ["z1"]
    assert got["alembic", 2].content == "ALTER TABLE users DROP COLUMN n;\nALTER TABLE users ADD COLUMN m INTEGER;\nDROP TABLE users;"
    assert got["django", 1].content == "CREATE TABLE item (id TEXT NOT NULL, n TEXT NOT NULL);\nSELECT 1;" and got["django", 1].depends_on == ["0000"]
    events = mg.migration_events(mg.statements_of(mg.migrations(df)))
    broken = {(r.scope.split("/")[0], r.kind, r.name) for r in schema.breaking_changes(events, schema.history(events)).collect()}
    assert broken == {("flyway", "table", "t"), ("liquibase", "table", "a"), ("prisma", "table", "z"), ("alembic", "column", "n"), ("alembic", "table", "users"), ("django", "column", "n"), ("django", "table", "item")}
    assert mg.migrations(df.limit(0)).collect() == []


ALEMBIC = """
revision: str = 'r2'
down_revision = ('r1', 'r0')
def upgrade():
    op.create_table('t', sa.Column('id', sa.BigInteger(), primary_key=True), sa.Column('u', sa.Integer, sa.ForeignKey('users.id'), nullable=False), sa.Column('k', sa.String(9), unique=True),
        sa.PrimaryKeyConstraint('id'), sa.ForeignKeyConstraint(['k'], ['keys.k']))
    op.create_table('bare')
    if True:
        op.rename_table('a', 'b')
    with op.batch_alter_table('t') as batch:
        batch.add_column(sa.Column('x', sa.DateTime(), server_default='now'))
        batch.alter_column('k', new_column_name='kk')
        batch.drop_index('ix')
    op.alter_column('t', 'x', type_=sa.Text(), nullable=True)
    op.execute(f"DROP TABLE {x}")
    op.bulk_insert(t, [])
    other.drop_table('no')
def downgrade():
    op.drop_table('t')
"""
DJANGO = """
class Migration(migrations.Migration):
    operations = [
        migrations.CreateModel('Book', [('id', models.BigAutoField(primary_key=True)), ('author', models.ForeignKey(to='app.Author', null=True)), ('tags', models.ManyToManyField('Tag'))], options={'db_table': 'books'}),
        migrations.AlterField('Book', 'title', models.CharField(max_length=9, unique=True)),
        migrations.RenameField('Book', 'a', 'b'), migrations.RenameModel('Old', 'New'),
        migrations.AddIndex('Book', models.Index(fields=['title'], name='ix')), migrations.RemoveIndex('Book', 'ix'),
        migrations.SeparateDatabaseAndState(database_operations=[migrations.RunSQL("DELETE FROM books;", "")]), migrations.RunPython(f),
    ]
"""


def test_operations():
    (framework, _, version, follows, steps), = mg.scripts("p/x.py", ALEMBIC)
    assert (framework, version, follows) == ("alembic", "r2", ["r1", "r0"])
    assert [sql for sql, _ in steps] == [
        "CREATE TABLE t (id BIGINT PRIMARY KEY, u INTEGER NOT NULL REFERENCES users(id), k VARCHAR UNIQUE REFERENCES keys(k));", "CREATE TABLE bare;", "ALTER TABLE a RENAME TO b;",
        "ALTER TABLE t ADD COLUMN x TIMESTAMP;", "ALTER TABLE t RENAME COLUMN k TO kk;", "DROP INDEX ix;", "ALTER TABLE t ADD COLUMN x TEXT;",
    ]
    assert [(e["kind"], e["action"], e["name"]) for e in steps[2][1]] == [("table", "drop", "a"), ("table", "create", "b")]
    (framework, _, version, _, steps), = mg.scripts("p/0001_x.py", DJANGO)
    assert (framework, version) == ("django", "0001_x")
    assert [sql for sql, _ in steps] == [
        "CREATE TABLE books (id BIGINT PRIMARY KEY, author_id INTEGER REFERENCES author(id));", "ALTER TABLE book ADD COLUMN title VARCHAR NOT NULL UNIQUE;", "ALTER TABLE book RENAME COLUMN a TO b;",
        "ALTER TABLE old RENAME TO new;", "CREATE INDEX ix ON book (title);", "DROP INDEX ix;", "DELETE FROM books;",
    ]
    assert mg.scripts("p/y.py", "def (") == [] and mg.scripts("p/__init__.py", "revision = 'x'") == []
