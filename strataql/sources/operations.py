"""Schema operations of Python migrations as schema events, and the events as DDL.

Two kinds of migration are read: scripts that call `op.<operation>(...)` in upgrade(), and classes
with a list of `operations`. A call's arguments are bound to the names that the frameworks document
for the operation; what an operation does is one entry of a table: its events. Strings that are run
as SQL are kept as they are.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from strataql.operators.schema import _event

# Types as the two frameworks name them.
TYPES = {
    "integer": "INTEGER", "smallinteger": "SMALLINT", "biginteger": "BIGINT", "string": "VARCHAR", "unicode": "VARCHAR", "varchar": "VARCHAR", "text": "TEXT", "unicodetext": "TEXT", "char": "CHAR",
    "numeric": "DECIMAL", "decimal": "DECIMAL", "float": "FLOAT", "double": "DOUBLE", "boolean": "BOOLEAN", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "time": "TIME", "json": "JSON", "jsonb": "JSONB", "array": "ARRAY",
    "autofield": "INTEGER", "bigautofield": "BIGINT", "smallautofield": "SMALLINT", "integerfield": "INTEGER", "positiveintegerfield": "INTEGER", "positivesmallintegerfield": "SMALLINT", "smallintegerfield": "SMALLINT", "bigintegerfield": "BIGINT",
    "charfield": "VARCHAR", "slugfield": "VARCHAR", "emailfield": "VARCHAR", "urlfield": "VARCHAR", "filefield": "VARCHAR", "imagefield": "VARCHAR", "textfield": "TEXT", "decimalfield": "DECIMAL", "floatfield": "DOUBLE", "booleanfield": "BOOLEAN",
    "datetimefield": "TIMESTAMP", "datefield": "DATE", "timefield": "TIME", "jsonfield": "JSONB", "foreignkey": "INTEGER", "onetoonefield": "INTEGER",
}

# The documented parameters of the operations, in order; a star takes all further ones.
PARAMETERS = {
    "create_table": "table_name *columns", "drop_table": "table_name", "rename_table": "old_table_name new_table_name", "add_column": "table_name column", "drop_column": "table_name column_name",
    "alter_column": "table_name column_name", "create_index": "index_name table_name columns", "drop_index": "index_name table_name", "create_primary_key": "constraint_name table_name columns",
    "create_unique_constraint": "constraint_name table_name columns", "create_foreign_key": "constraint_name source_table referent_table local_cols remote_cols", "execute": "sqltext", "bulk_insert": "table rows",
    "CreateModel": "name fields options", "DeleteModel": "name", "RenameModel": "old_name new_name", "AddField": "model_name name field", "RemoveField": "model_name name", "AlterField": "model_name name field",
    "RenameField": "model_name old_name new_name", "AddIndex": "model_name index", "RemoveIndex": "model_name name", "RunSQL": "sql reverse_sql", "AlterModelTable": "name table",
}
#: Operations on a table that is given once, by `with op.batch_alter_table(...)`.
BATCHED = frozenset("add_column drop_column alter_column create_index drop_index create_primary_key create_unique_constraint create_foreign_key".split())


@dataclass
class Call:
    """A call in source: its last name, its arguments by parameter, and further positional ones."""

    name: str
    args: dict[str, ast.AST] = field(default_factory=dict)
    more: list[ast.AST] = field(default_factory=list)

    def text(self, name: str) -> str:
        return literal(self.args.get(name))


def literal(node: ast.AST | None) -> str:
    """A constant's text; empty for what is worked out when the script runs, and for None."""
    return str(node.value) if isinstance(node, ast.Constant) and node.value is not None else ""


def literals(node: ast.AST | None) -> list[str]:
    return [t for t in map(literal, getattr(node, "elts", [])) if t]


def read_call(node: ast.AST | None, table: str = "") -> Call | None:
    """A call bound to its documented parameters; None for anything else."""
    if not isinstance(node, ast.Call):
        return None
    name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
    call, given = Call(name), list(node.args)
    for parameter in PARAMETERS.get(name, "*more").split():
        if table and parameter in ("table_name", "source_table"):
            call.args[parameter] = ast.Constant(table)
        elif parameter[0] == "*":
            call.more, given = given, []
        elif given:
            call.args[parameter] = given.pop(0)
    call.args |= {k.arg: k.value for k in node.keywords if k.arg}
    return call


def _is_true(call: Call, name: str) -> bool:
    return call.text(name) == "True"


def _table_column(table: str, node: ast.AST, ordinal: int) -> list[dict]:
    """Column("name", Type(...), ForeignKey("t.c"), nullable=..., ...), and constraints over columns as changes to come."""
    call = read_call(node)
    if call is None or call.name != "Column" or not call.more:
        return []
    kinds = [read_call(x) or Call(getattr(x, "attr", getattr(x, "id", ""))) for x in call.more[1:]]
    known = [TYPES[k.name.lower()] for k in kinds if k.name.lower() in TYPES]
    target = next((literal(k.more[0]) for k in kinds if k.name == "ForeignKey" and k.more), None)
    primary = _is_true(call, "primary_key")
    default = call.text("server_default") or None
    return [_event("column", "create", table, literal(call.more[0]), type=known[0] if known else "UNKNOWN", nullable=not primary and call.text("nullable") != "False", default_text=default, primary_key=primary, is_unique=_is_true(call, "unique"), foreign_key=target, ordinal=ordinal)]


def _model_column(table: str, name: str, node: ast.AST | None, ordinal: int) -> list[dict]:
    """A model's field as a column; a reference's column ends in _id, many-to-many fields have none."""
    call = read_call(node) or Call("")
    if call.name == "ManyToManyField":
        return []
    refers = call.name in ("ForeignKey", "OneToOneField")
    to = (call.text("to") or (literal(call.more[0]) if call.more else "")).rpartition(".")[2].lower() if refers else ""
    column = call.text("db_column") or (f"{name}_id" if refers else name)
    primary = _is_true(call, "primary_key")
    return [_event("column", "create", table, column, type=TYPES.get(call.name.lower(), "UNKNOWN"), nullable=_is_true(call, "null"), default_text=call.text("default") or None, primary_key=primary, is_unique=_is_true(call, "unique") or call.name == "OneToOneField", foreign_key=f"{to}.id" if to else None, ordinal=ordinal)]


def _index(table: str, name: str, columns: list[str], unique: bool = False) -> dict:
    return _event("index", "create", table, name, columns=columns, is_unique=unique)


def _created(c: Call) -> list[dict]:
    table = c.text("table_name")
    out = [_event("table", "create", table, table)]
    for node in c.more:
        out += _table_column(table, node, len(out))
    by_name = {e["name"]: e for e in out[1:]}
    for node in c.more:
        made = read_call(node)
        if made is None:
            continue
        named = [by_name[n] for n in map(literal, made.more) if n in by_name]
        for e in named if made.name in ("PrimaryKeyConstraint", "UniqueConstraint") and made.more else []:
            e |= {"primary_key": True, "nullable": False} if made.name[0] == "P" else {"is_unique": len(named) == 1}
        if made.name == "ForeignKeyConstraint" and len(made.more) > 1:
            for n, to in zip(literals(made.more[0]), literals(made.more[1])):
                by_name.get(n, {})["foreign_key"] = to
    return out


def _model(c: Call) -> list[dict]:
    options = c.args.get("options")
    pairs = dict(zip(map(literal, getattr(options, "keys", [])), map(literal, getattr(options, "values", []))))
    table = pairs.get("db_table") or c.text("name").lower()
    out = [_event("table", "create", table, table)]
    for f in getattr(c.args.get("fields"), "elts", []):
        parts = getattr(f, "elts", [])
        if len(parts) == 2:
            out += _model_column(table, literal(parts[0]), parts[1], len(out))
    return out


def _moved(kind: str, table: str, old: str, new: str) -> list[dict]:
    return [_event(kind, "drop", old if kind == "table" else table, old), _event(kind, "create", new if kind == "table" else table, new)]


def _altered(c: Call) -> list[dict]:
    table, old = c.text("table_name"), c.text("column_name")
    kind = read_call(c.args.get("type_")) or Call(getattr(c.args.get("type_"), "attr", ""))
    if c.text("new_column_name"):
        return _moved("column", table, old, c.text("new_column_name"))
    known = TYPES.get(kind.name.lower())
    nullable = {"True": True, "False": False}.get(c.text("nullable"))
    return [_event("column", "create", table, old, type=known or "UNKNOWN", nullable=nullable, ordinal=1_000_000)] if known or nullable is not None else []


def _django_index(c: Call) -> list[dict]:
    made = read_call(c.args.get("index")) or Call("")
    return [_index(c.text("model_name").lower(), made.text("name"), literals(made.args.get("fields")))]


#: The events of each operation.
EVENTS: dict[str, Callable[[Call], list[dict]]] = {
    "create_table": _created,
    "drop_table": lambda c: [_event("table", "drop", c.text("table_name"), c.text("table_name"))],
    "rename_table": lambda c: _moved("table", "", c.text("old_table_name"), c.text("new_table_name")),
    "add_column": lambda c: _table_column(c.text("table_name"), c.args.get("column"), 1_000_000),
    "drop_column": lambda c: [_event("column", "drop", c.text("table_name"), c.text("column_name"))],
    "alter_column": _altered,
    "create_index": lambda c: [_index(c.text("table_name"), c.text("index_name"), literals(c.args.get("columns")), _is_true(c, "unique"))],
    "drop_index": lambda c: [_event("index", "drop", c.text("table_name"), c.text("index_name"))],
    "CreateModel": _model,
    "DeleteModel": lambda c: [_event("table", "drop", c.text("name").lower(), c.text("name").lower())],
    "RenameModel": lambda c: _moved("table", "", c.text("old_name").lower(), c.text("new_name").lower()),
    "AddField": lambda c: _model_column(c.text("model_name").lower(), c.text("name"), c.args.get("field"), 1_000_000),
    "AlterField": lambda c: _model_column(c.text("model_name").lower(), c.text("name"), c.args.get("field"), 1_000_000),
    "RemoveField": lambda c: [_event("column", "drop", c.text("model_name").lower(), c.text("name"))],
    "RenameField": lambda c: _moved("column", c.text("model_name").lower(), c.text("old_name"), c.text("new_name")),
    "AddIndex": _django_index,
    "RemoveIndex": lambda c: [_event("index", "drop", c.text("model_name").lower(), c.text("name"))],
}
#: Operations that run SQL, by the parameter that holds it.
RUNS = {"execute": "sqltext", "RunSQL": "sql"}

Step = tuple[str, list[dict]]


def ddl(events: list[dict]) -> str:
    """The events of one operation as DDL."""
    if not events:
        return ""
    first, kept = events[0], {(e["kind"], e["action"]) for e in events}
    if (first["kind"], first["action"]) == ("table", "create"):
        columns = ", ".join(_definition(e) for e in events[1:])
        return f"CREATE TABLE {first['name']}" + (f" ({columns})" if columns else "") + ";"
    if kept == {("table", "drop"), ("table", "create")}:
        return f"ALTER TABLE {first['name']} RENAME TO {events[1]['name']};"
    if kept == {("column", "drop"), ("column", "create")}:
        return f"ALTER TABLE {first['table_name']} RENAME COLUMN {first['name']} TO {events[1]['name']};"
    shapes = {
        ("table", "drop"): lambda e: f"DROP TABLE {e['name']};",
        ("column", "drop"): lambda e: f"ALTER TABLE {e['table_name']} DROP COLUMN {e['name']};",
        ("column", "create"): lambda e: f"ALTER TABLE {e['table_name']} ADD COLUMN {_definition(e)};",
        ("index", "create"): lambda e: f"CREATE {'UNIQUE ' if e['is_unique'] else ''}INDEX {e['name']} ON {e['table_name']} ({', '.join(e['columns'])});",
        ("index", "drop"): lambda e: f"DROP INDEX {e['name']};",
    }
    return "\n".join(shapes[e["kind"], e["action"]](e) for e in events)


def _definition(e: dict) -> str:
    parts = [e["name"], e["type"] if e["type"] != "UNKNOWN" else "TEXT"]
    if e["primary_key"]:
        parts.append("PRIMARY KEY")
    elif e["nullable"] is False:
        parts.append("NOT NULL")
    if e["is_unique"]:
        parts.append("UNIQUE")
    if e["foreign_key"]:
        table, _, column = e["foreign_key"].rpartition(".")
        parts.append(f"REFERENCES {table}({column})")
    return " ".join(parts)


def _step(call: Call | None) -> Step | None:
    """What a call does: (SQL, events), or the SQL that it runs, whose events are read off it later."""
    if call is None:
        return None
    if call.name in RUNS:
        sql = call.text(RUNS[call.name]).strip().rstrip(";")
        return (sql + ";", []) if sql else None
    events = EVENTS[call.name](call) if call.name in EVENTS else []
    return (ddl(events), events) if events else None


def upgrade_steps(body: list[ast.stmt], owner: str = "op", table: str = "") -> Iterator[Step]:
    """The steps of upgrade() in source order, batches of one table included."""
    for statement in body:
        if isinstance(statement, ast.With):
            batch = read_call(statement.items[0].context_expr)
            inner = statement.items[0].optional_vars
            if batch and batch.name == "batch_alter_table" and isinstance(inner, ast.Name):
                yield from upgrade_steps(statement.body, inner.id, literal(batch.more[0]) if batch.more else batch.text("table_name"))
            else:
                yield from upgrade_steps(statement.body, owner, table)
            continue
        for name in ("body", "orelse", "finalbody"):
            yield from upgrade_steps(getattr(statement, name, []), owner, table)
        value = getattr(statement, "value", None)
        if isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and isinstance(value.func.value, ast.Name) and value.func.value.id == owner:
            step = _step(read_call(value, table if value.func.attr in BATCHED else ""))
            if step:
                yield step


def model_steps(operations: ast.AST | None) -> Iterator[Step]:
    """The steps of a migration class' operations, those that only separate state from database included."""
    for node in getattr(operations, "elts", []):
        call = read_call(node)
        if call and call.name == "SeparateDatabaseAndState":
            yield from model_steps(call.args.get("database_operations"))
            continue
        step = _step(call)
        if step:
            yield step
