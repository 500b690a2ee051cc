"""Local grammars: whether one balanced statement is syntactically valid in a SQL dialect.

The input is the statement's shape, one word for a token: keywords in lower case, `i` a bare name,
`q` a quoted name, `s` a string, `n` a number, `v` a variable or bind, and operators as they are.
Queries, DML and CREATE TABLE are parsed; administrative statements are checked by their head and
by how they end. Only syntax counts, never whether a name exists.
"""

from __future__ import annotations

import sys

#: Calls of the parser that may be open for each word of a text.
FRAMES_A_WORD = 24

# Words that can't be a bare column, table or alias name.
RESERVED = frozenset(
    """select from where and or not in is null insert into values update set delete join left right inner outer
    full cross on group by order having limit offset distinct as case when then else end with union all create
    table using exists between like intersect except""".split()
)
#: Words with a meaning in a grammar below; elsewhere they may be names.
SOFT = frozenset(
    """ilike rlike regexp glob similar escape over partition rows range groups qualify window fetch first next only top
    percent ties for of nowait skip locked share view index unique function procedure trigger merge matched returning
    conflict do nothing duplicate key ignore replace primary foreign references default check constraint collate
    array struct unnest lateral tablesample pivot unpivot natural asc desc nulls last interval cast try_cast
    safe_cast extract row_number recursive temporary temp if or or materialized alter drop truncate grant revoke
    begin commit rollback declare exec execute call copy attach detach pragma use show describe explain analyze
    vacuum database schema role user login credential mapping sequence type domain extension lock comment language
    against return returns dual minus apply output overwrite go start transaction isnull notnull filter within respect
    current row unbounded preceding following date time timestamp change reset unload put get list
    loop while elsif elseif exception try catch tran repeat until perform raise raiserror open close exit leave iterate
    continue signal resignal print throw waitfor deallocate let savepoint
    nolock option connect prior nocycle level sample bernoulli system values true false""".split()
)
KEYWORDS = RESERVED | SOFT

LIMIT = {"postgresql", "mysql", "sqlite", "snowflake", "bigquery", "redshift"}
FETCH = {"postgresql", "oracle", "tsql", "snowflake"}
TOP = {"tsql", "snowflake", "redshift"}
COLON_CAST = {"postgresql", "redshift", "snowflake"}
ILIKE = {"postgresql", "redshift", "snowflake"}
QUALIFY = {"snowflake", "bigquery", "redshift"}
RETURNING = {"postgresql", "sqlite", "oracle"}
MERGE = {"oracle", "tsql", "snowflake", "bigquery", "postgresql", "redshift"}
ARRAY_LITERAL = {"snowflake", "bigquery"}
SUBSCRIPT = {"postgresql", "bigquery", "snowflake", "redshift"}

COMPARE = frozenset(["=", "<", ">", "<=", ">=", "<>", "!="])
#: Other infix operators by the dialects that know them; "" stands for all.
INFIX = {
    "+": "", "-": "", "*": "", "/": "", "||": "", "%": "",
    "|": "", "&": "",
    "^": ("postgresql", "mysql", "tsql", "redshift", "bigquery"),
    "<=>": ("mysql",),
    "->": ("postgresql", "mysql", "sqlite", "redshift"),
    "->>": ("postgresql", "mysql", "sqlite", "redshift"),
    "#>": ("postgresql",), "#>>": ("postgresql",), "@>": ("postgresql",), "<@": ("postgresql",), "&&": ("postgresql", "mysql"),
    "~": ("postgresql", "redshift"), "!~": ("postgresql", "redshift"), "~*": ("postgresql", "redshift"), "!~*": ("postgresql", "redshift"),
    "<<": "", ">>": "",
    ":=": ("mysql",), "==": ("sqlite",),
    ":": ("snowflake",),
}
NAMES = frozenset("iq")


class Invalid(Exception):
    """The shape is no statement of the dialect."""


class Parser:
    """Recursive descent over one shape."""

    def __init__(self, words: list[str], dialect: str, names: list[str] | None = None) -> None:
        self.w, self.i, self.d = [*words, "$"], 0, dialect
        #: The words as they are spelt, in lower case: for statements whose keywords are names elsewhere.
        self.spelt = [*(names or words), "$"]

    # -- helpers
    @property
    def now(self) -> str:
        return self.w[self.i]

    def peek(self, k: int = 1) -> str:
        return self.w[min(self.i + k, len(self.w) - 1)]

    @property
    def word(self) -> str:
        return self.spelt[self.i]

    def takes(self, *words: str) -> bool:
        """take by spelling."""
        if self.spelt[self.i] in words:
            self.i += 1
            return True
        return False

    def needs(self, *words: str) -> None:
        if not self.takes(*words):
            raise Invalid(f"{self.word} where {'/'.join(words)} should be")

    def take(self, *words: str) -> bool:
        if self.w[self.i] in words:
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise Invalid(f"{self.now} where {'/'.join(words)} should be")

    def is_name(self, word: str) -> bool:
        return word in NAMES or (word in SOFT and word not in ("true", "false"))

    def name(self) -> None:
        if not self.is_name(self.now):
            raise Invalid(f"{self.now} where a name should be")
        self.i += 1

    def dotted(self) -> None:
        if self.d in ("tsql", "mysql") and self.take("v"):
            return
        self.name()
        while self.take("."):
            if self.now == ".":  # server..table
                continue
            if not self.take("*"):
                if self.now in KEYWORDS or self.now == "v" and self.d == "snowflake":
                    self.i += 1
                else:
                    self.name()

    def comma_list(self, item) -> None:
        item()
        while self.take(","):
            item()

    def alias(self) -> None:
        if self.take("as"):
            if not self.take("s"):
                if self.now in RESERVED:
                    raise Invalid("reserved alias")
                self.name()
        elif self.now in NAMES or (self.now == "s" and self.d in ("mysql", "sqlite")):
            self.i += 1
        elif self.now in SOFT and self.now not in _NO_ALIAS and not (self.d == "tsql" and self.now in _STEPS):
            self.i += 1

    # -- scripts
    def script(self) -> None:
        while self.take(";"):
            pass
        while self.now != "$":
            self.statement()
            if self.now == "$":
                return
            if self.d == "tsql" and self.now != ";":
                continue
            self.need(";")
            while self.take(";") or self.d == "oracle" and self.take("/"):
                pass

    def statement(self) -> None:
        w = self.now
        if w in ("select", "with", "(", "values"):
            self.query()
        elif w == "insert" or (w == "replace" and self.d in ("mysql", "sqlite")):
            self.insert()
        elif w == "update":
            self.update()
        elif w == "delete":
            self.delete()
        elif w == "merge" and self.d in MERGE:
            self.merge()
        elif w == "create":
            self.create()
        elif w == "explain":
            self.explain()
        elif w in ("drop", "truncate", "grant", "revoke", "alter"):
            getattr(self, w)()
        elif self.word == "load" and self.d == "mysql":
            self.i += 1
            self.rest("load")
        elif w == "from" and self.d == "bigquery":
            self.pipes()
        elif w == "if" and self.d in _HEADS["if"] or w == "while" and self.d == "tsql" or w == "begin" and self.opens_block():
            self.step()
        elif w in _HEADS:
            if _HEADS[w] and self.d not in _HEADS[w]:
                raise Invalid(f"{w} is not in this dialect")
            self.i += 1
            self.rest(w)
        else:
            raise Invalid(f"a statement can't begin with {w}")

    def rest(self, head: str) -> None:
        """Administrative statements: any balanced words up to the next semicolon, with a whole end."""
        depth, last, n = 0, head, 0
        if head in ("begin", "declare") and self.d in ("oracle", "mysql", "postgresql", "tsql", "snowflake", "bigquery", "redshift"):
            if head == "declare" and self.now == "v":
                if self.d != "tsql":
                    raise Invalid("a variable can't be declared so in this dialect")
            elif head == "declare" and self.d in ("oracle", "snowflake") and "begin" in self.w[self.i :]:
                return self.blocks()
        while self.now != "$" and (depth or self.now != ";"):
            w = self.now
            depth += (w == "(") - (w == ")")
            if depth < 0:
                raise Invalid("a bracket too many")
            if head == "declare" and w == "select" and depth == 0 and self.d == "tsql":
                break
            last = w
            n += 1
            self.i += 1
        if depth or (n == 0 and head not in ("commit", "rollback", "begin", "go", "end", "show", "vacuum", "analyze", "return", "explain")):
            raise Invalid("cut short")
        if last in (",", ".", "=", "+", "-", "(", "||") or (n and last in RESERVED and last not in ("null", "end", "all", "default", "on", "full", "table")):
            raise Invalid("cut short")

    # -- queries
    def query(self) -> None:
        if self.take("with"):
            self.take("recursive")
            while True:
                self.name()
                if self.take("("):
                    self.comma_list(self.name)
                    self.need(")")
                self.need("as")
                if self.take("not"):
                    self.need("materialized")
                else:
                    self.take("materialized")
                self.need("(")
                if self.now in ("insert", "update", "delete"):
                    self.statement()
                else:
                    self.query()
                self.need(")")
                if not self.take(","):
                    break
            if self.now == "insert":
                return self.insert()
            if self.now == "update":
                return self.update()
            if self.now == "delete":
                return self.delete()
            if self.now == "merge" and self.d in MERGE:
                return self.merge()
        self.set_operand()
        while self.now in ("union", "intersect", "except", "minus"):
            self.i += 1
            if not self.take("all"):
                self.take("distinct")
            self.set_operand()
        self.tail()

    def set_operand(self) -> None:
        if self.take("("):
            self.query()
            self.need(")")
        elif self.take("values"):
            self.comma_list(self.row)
        else:
            self.select()

    def row(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        self.comma_list(self.value)
        self.need(")")

    def value(self) -> None:
        if not (self.now == "default" and self.take("default")):
            self.expr()

    def select(self) -> None:
        self.need("select")
        if self.take("distinct"):
            if self.take("on"):
                self.row()
        else:
            self.take("all")
        if self.now == "top" and self.d in TOP and self.peek() in ("(", "n", "v"):
            self.i += 1
            if self.take("("):
                self.expr()
                self.need(")")
            else:
                self.i += 1
            self.take("percent")
            if self.now == "with" and self.peek() == "ties":
                self.i += 2
        self.comma_list(self.select_item)
        if self.now == "," and self.d == "bigquery":
            self.i += 1
        if self.take("into"):
            self.comma_list(self.target)
        if self.take("from"):
            self.sources()
        elif self.d == "oracle":
            raise Invalid("no FROM")
        if self.take("where"):
            self.expr()
        while self.d == "oracle" and self.now in ("connect", "start"):
            self.i += 1
            self.need("by", "with")
            self.take("nocycle")
            self.expr()
        if self.take("group"):
            self.need("by")
            if self.take("all"):
                pass
            else:
                self.comma_list(self.group_item)
                if self.take("with"):
                    self.name()
        if self.take("having"):
            self.expr()
        if self.take("window"):
            self.comma_list(self.window_def)
        if self.now == "qualify":
            if self.d not in QUALIFY:
                raise Invalid("no QUALIFY")
            self.i += 1
            self.expr()

    def group_item(self) -> None:
        if self.word in ("grouping", "rollup", "cube"):
            if self.takes("grouping"):
                if not self.takes("sets"):
                    self.i -= 1
                    return self.expr()
            else:
                self.i += 1
            return self.brackets() if self.now == "(" else None
        self.expr()

    def pipes(self) -> None:
        """FROM first, then a chain of operators behind |>."""
        self.need("from")
        self.sources()
        while self.now == "|" and self.peek() == ">":
            self.i += 2
            if self.take("where", "having"):
                self.expr()
            elif self.take("select"):
                self.take("distinct", "all")
                self.comma_list(self.select_item)
            elif self.takes("extend", "aggregate", "set", "drop", "rename", "window"):
                if self.now not in ("group", "|"):
                    self.comma_list(self.pipe_item)
                if self.take("group"):
                    if not (self.take("and") and self.take("order")):
                        pass
                    self.need("by")
                    self.comma_list(self.select_item)
            elif self.take("as"):
                self.name()
            elif self.now in ("order", "limit"):
                self.tail()
            elif self.take("distinct"):
                pass
            elif self.now in ("union", "intersect", "except"):
                self.i += 1
                self.take("all", "distinct")
                self.comma_list(self.set_operand)
            elif self.now in ("join", "left", "right", "full", "inner", "cross"):
                k = self.i
                while self.now in ("left", "right", "full", "inner", "cross", "outer"):
                    self.i += 1
                self.need("join")
                self.source()
                if self.take("on"):
                    self.expr()
                elif self.take("using"):
                    self.brackets()
            elif self.now in ("tablesample", "pivot", "unpivot", "call"):
                self.i += 1
                while self.now not in ("|", "$", ";"):
                    self.brackets() if self.now == "(" else self.name()
            else:
                raise Invalid("no such pipe")

    def pipe_item(self) -> None:
        self.select_item()
        if self.take("="):
            self.expr()
        self.take("asc", "desc")

    def window_def(self) -> None:
        self.name()
        self.need("as")
        self.window()

    def select_item(self) -> None:
        if self.d == "bigquery" and self.now == "from":
            return  # a trailing comma
        if self.take("*"):
            while self.now in ("except", "replace") and self.peek() == "(" and self.d in ("bigquery", "snowflake"):
                self.i += 1
                self.brackets()
            return
        if self.d == "tsql" and self.now in ("i", "q", "v") and self.peek() == "=":
            self.i += 2
        self.expr()
        self.alias()

    def brackets(self) -> None:
        self.need("(")
        depth = 1
        while depth:
            if self.now == "$":
                raise Invalid("never closed")
            depth += (self.now == "(") - (self.now == ")")
            self.i += 1

    def sources(self) -> None:
        self.source()
        while True:
            if self.take(","):
                self.take("lateral")
                self.source()
                continue
            k = self.i
            self.take("natural")
            kind = self.now
            if kind == "cross" or kind == "outer" and self.peek() == "apply":
                self.i += 1
                if self.now == "apply" and self.d not in ("tsql", "oracle", "snowflake"):
                    raise Invalid("no APPLY")
                self.need("join", "apply")
                self.take("lateral")
                self.source()
                continue
            if self.take("inner"):
                pass
            elif self.take("left", "right", "full"):
                self.take("outer")
            if self.d == "tsql" and self.now == "i" and self.peek() == "join":
                self.i += 1
            if not self.take("join"):
                if self.i != k:
                    raise Invalid("no JOIN")
                return
            self.take("lateral")
            self.source()
            if self.take("on"):
                self.expr()
            elif self.take("using"):
                self.brackets()

    def source(self) -> None:
        if self.take("("):
            if self.now in ("select", "with", "values", "("):
                self.query()
            else:
                self.sources()
            self.need(")")
        elif self.now == "unnest" or self.now == "table" and self.peek() == "(":
            self.i += 1
            self.brackets()
            if self.now == "with" and self.peek() in ("offset", "i"):
                self.i += 2
        elif self.now == "v":
            self.i += 1
            while self.d == "snowflake" and self.take("/", "."):  # @stage/path
                self.name()
            if self.d == "snowflake" and self.now == "(":
                self.brackets()
        else:
            self.dotted()
            if self.now == "(":
                self.brackets()
        if self.now == "for" and self.peek() in ("i", "system", "s") and self.d in ("tsql", "bigquery") and self.spelt[self.i + 1] not in ("xml", "json", "browse"):
            while self.now not in ("$", ";", ")", "where", "join", "order", ",", "group", "as"):
                self.i += 1
        if self.now == "tablesample" or self.now == "sample" and self.peek() == "(":
            self.i += 1
            if self.now != "(":
                self.i += 1
            self.brackets()
        if self.now in ("pivot", "unpivot") and self.peek() == "(":
            self.i += 1
            self.brackets()
        self.alias()
        if self.now == "(" and self.w[self.i - 1] in NAMES:
            self.brackets()
        if self.now in ("pivot", "unpivot") and self.peek() == "(":
            self.i += 1
            self.brackets()
            self.alias()
        if self.now == "with" and self.peek() == "offset" and self.d == "bigquery":
            self.i += 2
            self.alias()
        if self.now == "with" and self.d == "tsql" and self.peek() == "(":
            self.i += 1
            self.brackets()
            self.alias()
        if self.now == "by" and self.d == "sqlite":  # INDEXED BY
            self.i += 1
            self.name()
        if self.d == "mysql" and self.now in ("i", "use", "ignore") and self.peek() in ("index", "key"):
            self.i += 2
            self.brackets()

    def tail(self) -> None:
        """ORDER BY, LIMIT and their like, after a whole query."""
        if self.take("order"):
            self.need("by")
            self.comma_list(self.order_item)
        while True:
            if self.now == "limit":
                if self.d not in LIMIT:
                    raise Invalid("no LIMIT")
                self.i += 1
                if not self.take("all"):
                    self.expr()
                if self.now == "," and self.d in ("mysql", "sqlite"):
                    self.i += 1
                    self.expr()
            elif self.now == "offset":
                self.i += 1
                self.expr()
                self.take("rows", "row")
            elif self.now == "fetch":
                if self.d not in FETCH:
                    raise Invalid("no FETCH")
                self.i += 1
                self.need("first", "next")
                if self.now not in ("rows", "row"):
                    self.expr()
                    self.take("percent")
                self.need("rows", "row")
                if self.take("with"):
                    self.need("ties")
                else:
                    self.need("only")
            elif self.now == "for" and self.peek() in ("update", "share", "i", "key"):
                self.i += 2
                while self.now not in ("$", ";", ")"):
                    self.brackets() if self.now == "(" else self.skip()
            elif self.now == "option" and self.d == "tsql":
                self.i += 1
                self.brackets()
            else:
                return

    def order_item(self) -> None:
        self.expr()
        if self.take("collate"):
            self.name()
        self.take("asc", "desc")
        if self.take("nulls"):
            self.need("first", "last")

    # -- expressions
    def expr(self) -> None:
        self.unary_not()
        while self.now in ("and", "or") or (self.now == "xor" and self.d == "mysql"):
            self.i += 1
            self.unary_not()

    def unary_not(self) -> None:
        while self.take("not"):
            pass
        self.predicate()

    def predicate(self) -> None:
        self.operand()
        while True:
            w = self.now
            if w in COMPARE or w == "==" and self.d == "sqlite":
                self.i += 1
                if self.now in ("all", "i") and self.peek() == "(" and self.now == "all":
                    self.i += 1
                self.operand()
            elif w == "is":
                self.i += 1
                self.take("not")
                if self.take("distinct"):
                    self.need("from")
                    self.operand()
                elif not self.take("null", "true", "false", "unknown", "i"):
                    if self.d != "sqlite":
                        raise Invalid("IS what")
                    self.operand()
            elif w in ("isnull", "notnull") and self.d in ("postgresql", "sqlite"):
                self.i += 1
            else:
                k = self.i
                self.take("not")
                w = self.now
                if w == "in":
                    self.i += 1
                    if self.d == "bigquery" and self.take("unnest"):
                        self.brackets()
                    elif self.now == "(":
                        self.i += 1
                        if self.now in ("select", "with"):
                            self.query()
                        else:
                            self.comma_list(self.expr)
                        self.need(")")
                    elif self.d in ("postgresql",) or self.now != "v":
                        raise Invalid("IN what")
                    else:
                        self.i += 1
                elif w == "between":
                    self.i += 1
                    if self.d == "postgresql" and self.now == "i" and self.peek() in ("n", "s", "v", "i", "q"):
                        self.i += 1  # SYMMETRIC
                    self.operand()
                    self.need("and")
                    self.operand()
                elif w in ("like", "ilike", "rlike", "regexp", "glob", "similar"):
                    if w == "ilike" and self.d not in ILIKE:
                        raise Invalid("no ILIKE")
                    self.i += 1
                    if w == "similar":
                        self.need("i")
                    if self.now in ("all", "i") and self.peek() == "(":
                        self.i += 1
                    self.operand()
                    if self.take("escape"):
                        self.operand()
                else:
                    self.i = k
                    return

    def operand(self) -> None:
        self.primary()
        while True:
            w = self.now
            if w == "::":
                if self.d not in COLON_CAST:
                    raise Invalid("no ::")
                self.i += 1
                self.type_name()
            elif w == "[" and self.d in SUBSCRIPT:
                self.i += 1
                if not self.take(":"):
                    self.expr()
                    if self.take(":"):
                        if self.now != "]":
                            self.expr()
                self.need("]")
            elif w == "p":  # a path into a variant
                self.i += 1
                while self.take("."):
                    self.name()
            elif w == "collate":
                self.i += 1
                if not self.take("s"):
                    self.dotted()
            elif w == "|" and self.peek() == ">" and self.d == "bigquery":
                return
            elif w in INFIX and (INFIX[w] == "" or self.d in INFIX[w]):
                self.i += 1
                if w == ":":
                    self.dotted()
                else:
                    self.primary()
            else:
                return

    def primary(self) -> None:
        w = self.now
        if w in ("-", "+", "~"):
            self.i += 1
            self.primary()
        elif w in ("n", "v", "p", "null", "true", "false", "?"):
            self.i += 1
            if w == "v" and self.d == "oracle" and self.take("."):  # :NEW.name
                self.name()
        elif w in ("s", "s$"):
            self.i += 1
            while self.now == "s":  # adjacent literals
                self.i += 1
        elif w == "(":
            self.i += 1
            if self.now in ("select", "with"):
                self.query()
            else:
                self.comma_list(self.expr)
            self.need(")")
        elif w == "case":
            self.case()
        elif w == "exists":
            self.i += 1
            self.need("(")
            self.query()
            self.need(")")
        elif w in ("cast", "try_cast", "safe_cast") and self.peek() == "(":
            self.i += 2
            self.expr()
            self.need("as")
            self.type_name()
            while self.now != ")" and self.now != "$":
                self.i += 1
            self.need(")")
        elif w == "extract" and self.peek() == "(":
            self.i += 1
            self.brackets()
        elif w == "interval" and self.peek() in ("s", "n", "(", "i"):
            self.i += 1
            self.primary()
            if self.now == "i":
                self.i += 1
        elif w in ("date", "time", "timestamp") and self.peek() == "s":
            self.i += 2
        elif w == "array" and self.peek() in ("[", "(", "<"):
            self.i += 1
            if self.now == "[":
                self.array()
            else:
                while self.now not in ("(", "[", "$"):
                    self.i += 1
                self.array() if self.now == "[" else self.brackets()
        elif w == "[" and self.d in ARRAY_LITERAL:
            self.array()
        elif w == "struct" and self.peek() in ("(", "<"):
            self.i += 1
            while self.now not in ("(", "$"):
                self.i += 1
            self.brackets()
        elif w == "i" and self.peek() == "s" and self.d in ("tsql", "mysql", "oracle", "postgresql", "bigquery", "sqlite"):
            self.i += 2  # N'..', x'..', DATE-like prefixes
        elif w in ("left", "right", "replace", "if", "values", "insert") and self.peek() == "(":
            self.i += 1
            self.call()
        elif w == "prior" and self.d == "oracle":
            self.i += 1
            self.primary()
        elif w == "default" and self.d in ("mysql", "postgresql", "tsql", "snowflake", "oracle"):
            self.i += 1
        else:
            if self.d == "redshift" and self.word == "approximate" and self.peek() == "i":
                self.i += 1
            self.dotted()
            if self.now == "(":
                self.call()
            if self.now == "against" and self.d == "mysql":
                self.i += 1
                self.brackets()

    def array(self) -> None:
        self.need("[")
        if not self.take("]"):
            self.comma_list(self.expr)
            self.need("]")

    def call(self) -> None:
        self.need("(")
        if not self.take(")"):
            if self.take("*"):
                pass
            elif self.now in ("select", "with"):
                self.query()
            else:
                if not self.take("distinct"):
                    self.take("all")
                self.comma_list(self.argument)
                if self.take("order"):
                    self.need("by")
                    self.comma_list(self.order_item)
                if self.now == "limit" or self.now == "i" or self.now in ("respect", "ignore"):
                    while self.now not in (")", "$"):
                        self.i += 1
            self.need(")")
        if self.now == "within" and self.peek() == "group":
            self.i += 2
            self.brackets()
        if self.now == "filter" and self.peek() == "(":
            self.i += 1
            self.brackets()
        if self.now in ("respect", "ignore") and self.peek() == "nulls":
            self.i += 2
        if self.take("over"):
            self.window()

    def argument(self) -> None:
        if self.now in NAMES and self.peek() == "=>":
            self.i += 2
        if self.now in ("i", "interval") and self.peek() == "from":
            self.i += 2
        self.expr()
        if self.take("as"):
            self.type_name()
        elif self.take("from", "for"):
            self.expr()
            if self.take("for"):
                self.expr()

    def window(self) -> None:
        if self.now in NAMES:
            self.i += 1
            return
        self.need("(")
        if self.now in NAMES:
            self.i += 1
        if self.take("partition"):
            self.need("by")
            self.comma_list(self.expr)
        if self.take("order"):
            self.need("by")
            self.comma_list(self.order_item)
        if self.take("rows", "range", "groups"):
            while self.now not in (")", "$"):
                self.i += 1
        self.need(")")

    def case(self) -> None:
        self.need("case")
        if self.now != "when":
            self.expr()
        self.need("when")
        while True:
            self.expr()
            self.need("then")
            self.expr()
            if not self.take("when"):
                break
        if self.take("else"):
            self.expr()
        self.need("end")

    def type_name(self, known: bool = False) -> None:
        """A type; where names are `known` by their spelling, only the further words that types have."""
        self.dotted()
        while known and self.word in ("precision", "varying", "large", "object", "character", "char", "raw") and not (self.word == "character" and self.peek() == "set"):
            self.i += 1
        while not known and (self.now == "i" and self.peek() in ("(", ")", ",", "i") or self.now in ("with", "time") and self.peek() in ("time", "i")):
            self.i += 1  # further words of a type: double precision, timestamp with time zone
        if self.now == "(":
            self.i += 1
            while True:
                if not self.take("n"):
                    self.name()
                self.take("i")
                if not self.take(","):
                    break
            self.need(")")
        if self.now == "<" and self.d == "bigquery":
            depth = 0
            while True:
                depth += {"<": 1, ">": -1, ">>": -2}.get(self.now, 0)
                if self.now == "$":
                    raise Invalid("type never closed")
                self.i += 1
                if depth <= 0:
                    break
        while self.now == "[" and self.peek() == "]":
            self.i += 2
        if self.word in ("with", "without") and self.spelt[self.i + 1 : self.i + 2] == ["time"]:
            self.i += 2
            self.takes("zone")
        elif self.word == "with" and self.spelt[self.i + 1 : self.i + 2] == ["local"]:
            self.i += 4

    # -- DML
    def insert(self) -> None:
        replaces = self.now == "replace"
        self.i += 1
        if not replaces and self.now == "or":
            if self.d != "sqlite":
                raise Invalid("no INSERT OR")
            self.i += 1
            self.name()
        if self.now == "ignore":
            if self.d != "mysql":
                raise Invalid("no INSERT IGNORE")
            self.i += 1
        if self.now == "overwrite" and self.d == "snowflake":
            self.i += 1
        if self.d in ("oracle", "snowflake") and self.now in ("all", "first"):
            return self.insert_all()
        if not self.take("into") and self.d not in ("mysql", "tsql", "bigquery"):
            raise Invalid("no INTO")
        self.take("table") if self.d == "snowflake" else None
        self.dotted()
        if self.take("as"):
            self.name()
        if self.now == "(" and self.peek() not in ("select", "with"):
            self.i += 1
            self.comma_list(self.dotted)
            self.need(")")
        if self.now == "output" and self.d == "tsql":
            self.i += 1
            self.comma_list(self.select_item)
            if self.take("into"):
                self.dotted()
        if self.now == "default" and self.peek() == "values":
            self.i += 2
        elif self.take("values"):
            self.comma_list(self.row)
            if self.d == "mysql":
                self.alias()
        elif self.now in ("select", "with", "("):
            self.query()
        elif self.now in ("exec", "execute") and self.d == "tsql":
            self.i += 1
            self.rest("exec")
            return
        elif self.now == "set" and self.d == "mysql":
            self.i += 1
            self.comma_list(self.assignment)
        else:
            raise Invalid("INSERT what")
        if self.now == "on":
            self.i += 1
            if self.take("duplicate"):
                if self.d != "mysql":
                    raise Invalid("no ON DUPLICATE KEY")
                self.need("key")
                self.need("update")
                self.comma_list(self.assignment)
            else:
                self.need("conflict")
                if self.d not in ("postgresql", "sqlite"):
                    raise Invalid("no ON CONFLICT")
                if self.now == "(":
                    self.brackets()
                elif self.take("on"):
                    self.need("constraint")
                    self.name()
                if self.take("where"):
                    self.expr()
                self.need("do")
                if not self.take("nothing"):
                    self.need("update")
                    self.need("set")
                    self.comma_list(self.assignment)
                    if self.take("where"):
                        self.expr()
        self.returning()

    def insert_all(self) -> None:
        """INSERT ALL or FIRST: targets, on conditions or without, and the query that feeds them."""
        self.i += 1
        n = 0
        while self.now in ("into", "when", "else"):
            if self.take("when"):
                self.expr()
                self.need("then")
            self.take("else")
            while self.take("into"):
                n += 1
                self.dotted()
                if self.now == "(":
                    self.brackets()
                if self.take("values"):
                    self.row()
        if not n:
            raise Invalid("INSERT ALL without INTO")
        self.query()

    def returning(self) -> None:
        if self.now == "returning":
            if self.d not in RETURNING:
                raise Invalid("no RETURNING")
            self.i += 1
            self.comma_list(self.select_item)
            if self.take("into"):
                self.comma_list(self.dotted)

    def assignment(self) -> None:
        if self.now == "(":
            self.brackets()
        else:
            self.dotted()
            if self.now == "[":
                self.array()
        if self.d == "tsql" and self.now in ("+", "-", "*", "/") and self.peek() == "=":
            self.i += 1
        self.need("=")
        if self.now == "default":
            self.i += 1
        else:
            self.expr()

    def update(self) -> None:
        self.need("update")
        if self.take("or"):
            if self.d != "sqlite":
                raise Invalid("no UPDATE OR")
            self.name()
        self.take("only")
        if self.d == "tsql" and self.now == "top":
            self.i += 1
            self.brackets()
        self.source()
        while self.d == "mysql" and self.now in (",", "join", "left", "inner", "cross", "right"):
            self.sources_more()
        self.need("set")
        self.comma_list(self.assignment)
        if self.now == "output" and self.d == "tsql":
            self.i += 1
            self.comma_list(self.select_item)
        if self.take("from"):
            if self.d in ("mysql", "oracle"):
                raise Invalid("no UPDATE FROM")
            self.sources()
        if self.now == "where" and self.peek() == "current" and self.peek(2) == "of":
            self.i += 3
            self.target()
        elif self.take("where"):
            self.expr()
        if self.d in ("mysql", "sqlite"):
            self.tail()
        if self.now == "option" and self.d == "tsql":
            self.tail()
        self.returning()

    def sources_more(self) -> None:
        if self.take(","):
            self.source()
            return
        self.take("left", "inner", "cross", "right")
        self.take("outer")
        self.need("join")
        self.source()
        if self.take("on"):
            self.expr()

    def delete(self) -> None:
        self.need("delete")
        if self.d == "tsql" and self.now == "top":
            self.i += 1
            self.brackets()
        if self.take("from"):
            self.take("only")
            self.source()
        elif self.d in ("tsql", "oracle", "mysql", "bigquery", "redshift"):
            self.comma_list(self.source)
        else:
            raise Invalid("no FROM")
        if self.now == "output" and self.d == "tsql":
            self.i += 1
            self.comma_list(self.select_item)
        if self.now == "from" and self.d in ("tsql", "mysql"):
            self.i += 1
            self.sources()
        if self.take("using"):
            self.sources()
        if self.now == "where" and self.peek() == "current" and self.peek(2) == "of":
            self.i += 3
            self.target()
        elif self.take("where"):
            self.expr()
        if self.d in ("mysql", "sqlite"):
            self.tail()
        if self.now == "option" and self.d == "tsql":
            self.tail()
        self.returning()

    def merge(self) -> None:
        self.need("merge")
        self.take("into")
        self.source()
        self.need("using")
        self.source()
        self.need("on")
        self.expr()
        n = 0
        while self.take("when"):
            n += 1
            self.take("not")
            self.need("matched")
            if self.take("by"):
                self.name()
            if self.take("and"):
                self.expr()
            self.need("then")
            if self.take("update"):
                self.need("set")
                self.comma_list(self.assignment)
                if self.take("where"):
                    self.expr()
                if self.take("delete"):
                    self.need("where")
                    self.expr()
            elif self.take("delete"):
                pass
            elif self.take("insert"):
                if self.now == "(":
                    self.brackets()
                if self.take("row"):
                    continue
                if self.take("default"):
                    self.need("values")
                else:
                    self.need("values")
                    self.row()
                if self.take("where"):
                    self.expr()
            else:
                self.need("do")
                self.need("nothing")
        if not n:
            raise Invalid("MERGE without WHEN")
        if self.now == "output" and self.d == "tsql":
            self.i += 1
            self.comma_list(self.select_item)

    # -- DDL
    def create(self) -> None:
        self.need("create")
        if self.take("or"):
            self.need("replace", "alter")
        words = []
        while self.now in ("temporary", "temp", "unique", "materialized", "i", "clustered") and self.now != "$" and self.peek() not in ("(", "."):
            if self.now == "i" and words.count("i") > 2:
                break
            words.append(self.now)
            self.i += 1
        if self.take("table"):
            self.create_table()
        elif self.take("view"):
            self.if_exists()
            self.dotted()
            if self.now == "(":
                self.brackets()
            while self.now not in ("as", "$", ";"):
                self.i += 1
            self.need("as")
            self.query()
            if self.take("with"):
                self.rest("with")
        elif self.take("index"):
            self.index()
        elif self.now in ("function", "procedure", "trigger"):
            self.routine()
        elif self.now in _CREATE:
            kind = self.now
            if _CREATE[kind] and self.d not in _CREATE[kind]:
                raise Invalid("can't be created in this dialect")
            self.i += 1
            if kind in ("user", "role", "login") and self.now not in ("mapping",):
                self.account(kind)
            else:
                self.rest("create")
        elif words:
            self.rest("create")
        else:
            raise Invalid("CREATE what")

    def account(self, kind: str) -> None:
        """CREATE USER, ROLE or LOGIN after that word: names, and options that begin as options do."""
        self.if_exists()
        while True:
            if not self.take("s", "v"):
                self.dotted()
            if self.take("v", "@"):
                self.take("s", "q", "i")
            if self.now not in ("$", ";", ","):
                if self.word not in _ACCOUNT and self.peek() != "=":
                    raise Invalid("no option of an account")
                depth = 0
                while self.now not in ("$", ";") and (depth or self.now != ","):
                    depth += (self.now == "(") - (self.now == ")")
                    self.i += 1
                if self.w[self.i - 1] in ("=", ".", "(", "by", "with"):
                    raise Invalid("cut short")
            if not self.take(",") or self.word in _ACCOUNT or self.peek() == "=":
                break
        if self.now not in ("$", ";"):
            self.rest("create")

    def kind(self, kinds: frozenset[str]) -> str:
        """The kind of an object, of up to three words."""
        for n in (3, 2, 1):
            words = self.spelt[self.i : self.i + n]
            if len(words) == n and " ".join(words) in kinds:
                self.i += n
                return " ".join(words)
        raise Invalid(f"{self.word} is no kind of object")

    def object_name(self) -> None:
        if self.now == "s":  # 'user'@'host'
            self.i += 1
            if self.take("@"):
                self.need("s", "q", "i")
            return
        self.dotted()
        if self.now == "(":
            self.brackets()
        if self.take("@"):
            self.need("s", "q", "i")

    def tokens_of(self, known: frozenset[str]) -> None:
        """Further words of a statement, all of them known; brackets and values stand behind one."""
        while self.now not in ("$", ";"):
            if self.now == "(" and self.w[self.i - 1] != "$":
                self.brackets()
            elif self.word in known:
                self.i += 1
                if self.take("="):
                    self.i += 1
            else:
                raise Invalid(f"{self.word} doesn't belong here")

    def drop(self) -> None:
        self.need("drop")
        while self.takes("temporary", "temp", "global", "public", "external", "foreign", "concurrently") and self.now not in ("$", ";"):
            pass
        if self.takes("owned"):
            return self.rest("drop")
        kind = self.kind(_KINDS)
        self.takes("concurrently")
        self.if_exists()
        self.takes("concurrently")
        self.comma_list(self.object_name)
        if self.take("on"):
            self.object_name()
        elif self.takes("from"):
            self.object_name()
        if kind in ("cast", "transform", "user mapping", "mapping", "operator class", "operator family", "statistics"):
            return self.rest("drop") if self.now not in ("$", ";") else None
        self.tokens_of(_DROP_TAIL)

    def truncate(self) -> None:
        self.need("truncate")
        if self.d == "sqlite":
            raise Invalid("no TRUNCATE")
        self.take("table", "cluster") or self.takes("table", "cluster")
        self.if_exists()
        self.take("only")
        self.comma_list(self.truncated)
        self.tokens_of(_TRUNCATE_TAIL)

    def truncated(self) -> None:
        self.dotted()
        self.take("*")

    def privilege(self) -> None:
        """A privilege or role: words, perhaps with columns."""
        n, wide = 0, False
        while self.word not in (",", "on", "to", "from", "$", ";"):
            if self.now == "(":
                self.brackets()
            elif self.now in ("s", "q", "v", ".", "@", "*") or self.now in KEYWORDS or self.now == "i":
                self.i += 1
            else:
                raise Invalid("no privilege")
            n += 1
            wide = wide or n > 1 and self.w[self.i - 2] not in (".", "@") and self.w[self.i - 1] not in (".", "@", ")")
        self.wide = self.wide or wide
        if not n:
            raise Invalid("no privilege")

    def grantee(self) -> None:
        n = 0
        while self.now not in (",", "with", "$", ";") and self.word not in ("granted", "identified", "cascade", "restrict", "container", "require", "as"):
            if self.now not in ("s", "q", "i", "v", ".", "@", "::", ":") and self.now not in SOFT and self.now != "group":
                raise Invalid("no grantee")
            n += 1
            self.i += 1
            if n > 6:
                raise Invalid("no grantee")
        if not n:
            raise Invalid("no grantee")

    def grant(self) -> None:
        self.rights("to")

    def revoke(self) -> None:
        self.rights("from")

    def rights(self, direction: str) -> None:
        if self.d == "sqlite":
            raise Invalid("no GRANT")
        self.i += 1
        for words in (("grant", "option", "for"), ("admin", "option", "for")):
            if tuple(self.spelt[self.i : self.i + 3]) == words:
                self.i += 3
        self.wide = False
        self.comma_list(self.privilege)
        if self.now != "on" and self.wide and self.d in ("postgresql", "redshift", "mysql", "bigquery"):
            raise Invalid("a role has one word")
        if self.take("on"):
            depth = 0
            n = 0
            while self.now not in ("$", ";") and (depth or self.word != direction):
                depth += (self.now == "(") - (self.now == ")")
                n += 1
                self.i += 1
            if not n or self.w[self.i - 1] in (".", ",", "("):
                raise Invalid("ON what")
        self.needs(direction)
        self.comma_list(self.grantee)
        if self.now not in ("$", ";"):
            if self.now != "with" and self.word not in ("granted", "identified", "cascade", "restrict", "container", "require", "as"):
                raise Invalid("not behind a grantee")
            self.i += 1
            if self.now in ("$", ";"):
                if self.spelt[self.i - 1] not in ("cascade", "restrict"):
                    raise Invalid("cut short")
            else:
                self.rest("grant")

    def alter(self) -> None:
        self.need("alter")
        if self.word in ("session", "system", "default"):
            self.i += 1
            return self.rest("alter")
        while self.takes("external", "foreign", "materialized", "global", "temporary", "public") and self.now not in ("$", ";"):
            pass
        kind = self.kind(_KINDS)
        self.takes("all")
        self.if_exists()
        self.take("only")
        if kind != "table":
            self.object_name()
            if self.d == "oracle" and self.now in ("$", ";"):
                raise Invalid("ALTER what")
            return self.rest("alter")
        self.dotted()
        self.take("*")
        if self.now == "(":
            self.brackets()
        self.action()
        while self.take(","):
            if self.word in _ACTIONS:
                self.action()
            else:
                self.added()
        if self.now not in ("$", ";") and self.d in ("oracle", "mysql", "snowflake", "tsql", "bigquery"):
            while self.now not in ("$", ";"):
                self.action()

    def action(self) -> None:
        """One action of ALTER TABLE."""
        head = self.word
        if head not in _ACTIONS:
            raise Invalid(f"{head} is no action")
        self.i += 1
        if head == "with" and self.takes("check", "nocheck"):
            head = "check"
            if self.takes("add"):
                return self.added()
        if head == "add":
            return self.added()
        if head in ("modify", "change"):
            self.takes("column")
            if self.now == "(":
                return self.brackets()
            if head == "change":
                self.name()
            self.table_item(("$", ";", ",", "first", "after"))
            if not self.takes("first") and self.takes("after"):
                self.name()
            return
        if head == "drop":
            self.takes("column", "constraint", "index", "key", "partition", "primary", "foreign", "check", "default", "clustering", "row", "search", "unique", "unused", "columns", "supplemental")
            self.takes("key", "access", "policy", "optimization")
            self.if_exists()
        n = self.i
        depth = 0
        while self.now not in ("$", ";") and (depth or self.now != ","):
            depth += (self.now == "(") - (self.now == ")")
            if depth < 0:
                raise Invalid("a bracket too many")
            self.i += 1
        if depth or self.w[self.i - 1] in (".", "=", "(", "to") or self.i == n and head in ("alter", "rename", "owner", "set", "drop") and self.spelt[self.i - 1] not in ("key", "columns", "default"):
            raise Invalid("cut short")

    def added(self) -> None:
        """What ALTER TABLE adds: columns, constraints, partitions, indexes."""
        ends = ("$", ";", ",", "first", "after")
        if self.word in ("partition", "partitions", "subpartition", "supplemental", "search", "row", "period", "system", "fulltext", "spatial", "clustering", "projection", "encrypted"):
            self.i += 1
            n = self.i
            while self.now not in ("$", ";", ","):
                self.brackets() if self.now == "(" else self.skip()
            if self.i == n:
                raise Invalid("ADD what")
            return
        self.takes("column", "columns")
        self.if_exists()
        if self.now == "(":
            self.i += 1
            self.comma_list(self.table_item)
            return self.need(")")
        self.table_item(ends)
        if self.takes("first"):
            return
        if self.takes("after"):
            self.name()

    def skip(self) -> None:
        self.i += 1

    def if_exists(self) -> None:
        if self.now == "if" and self.peek() in ("not", "exists"):
            self.i += 1
            self.take("not")
            self.need("exists")

    def create_table(self) -> None:
        self.if_exists()
        self.dotted()
        if self.now == "(":
            if self.peek() in ("select", "with"):
                self.brackets()
            else:
                self.i += 1
                self.comma_list(self.table_item)
                self.need(")")
        elif self.word not in _TABLE_TAIL and self.now not in ("$", ";"):
            raise Invalid("no columns")
        while self.now not in ("$", ";"):
            if self.now == "as" and self.peek() in ("select", "with", "(", "values"):
                break
            if self.now == "(":
                self.brackets()
            elif self.now == ")":
                raise Invalid("a bracket too many")
            elif self.now in ("select", "where", "and", "or"):
                break
            else:
                self.i += 1
        if self.take("as"):
            self.query()
        elif self.now in ("select", "with") and self.d == "mysql":
            self.query()
        if self.w[self.i - 1] in (",", "=", "."):
            raise Invalid("cut short")

    def table_item(self, ends: tuple[str, ...] = (",", ")")) -> None:
        """A column with its type and constraints, or a constraint of the table."""
        if self.now in ("primary", "foreign", "unique", "check", "constraint", "key", "index", "like") and self.peek() not in ("i",) or self.now == "constraint" or self.word in ("exclude", "period", "fulltext", "spatial"):
            n = self.i
            while self.word not in ends:
                if self.now == "(":
                    self.brackets()
                elif self.now in ("$", ";") or self.now in ("select", "from", "where", "and", "or", "then"):
                    raise Invalid("a constraint never ends")
                else:
                    self.i += 1
            if self.i - n < 2:
                raise Invalid("a constraint of one word")
            return
        self.name()
        if self.word in ends or self.word in _COLUMN:
            if self.d != "sqlite" and self.word not in ("as", "generated", "default", "set", "options"):
                raise Invalid("a column without a type")
        else:
            self.type_name(known=True)
        while self.word not in ends:
            if self.now in ("$", ";"):
                raise Invalid("a column never ends")
            if self.word not in _COLUMN:
                raise Invalid(f"{self.word} is no constraint")
            self.constraint()

    def constraint(self) -> None:
        """One constraint or property of a column."""
        word = self.word
        self.i += 1
        if word == "character":
            self.takes("set")
            self.name()
        elif word in ("not", "on"):
            return self.skip() if word == "not" else self.until_known()
        if word == "default":
            self.operand()
        elif word == "references":
            self.dotted()
            if self.now == "(":
                self.brackets()
        elif word in ("check", "as", "using", "options", "identity", "autoincrement", "by"):
            if self.now == "(":
                self.brackets()
        elif word in _COLUMN_NAMED:
            if not self.take("s", "n"):
                self.dotted()
                if self.now == "(":
                    self.brackets()
        elif self.now == "(":
            self.brackets()

    def until_known(self) -> None:
        """ON DELETE SET NULL and its like: words up to the next constraint or end."""
        self.takes("delete", "update", "conflict", "null", "default")
        self.takes("cascade", "restrict", "set", "no", "ignore", "replace", "abort", "fail", "rollback", "current_timestamp", "now")
        self.takes("null", "default", "action")
        if self.now == "(":
            self.brackets()

    def routine(self) -> None:
        """CREATE FUNCTION, PROCEDURE or TRIGGER: a quoted body, or a block up to the end of the text."""
        kind = self.now
        self.i += 1
        at = self.i
        self.if_exists()
        self.dotted()
        if self.now == "n" or self.word not in _ROUTINE[kind] and self.now not in ("(", "v", ";"):
            raise Invalid("no head of a routine")
        self.i = at
        rest = self.w[self.i : -1]
        if "s$" in rest:  # a dollar-quoted body
            if self.d not in ("postgresql", "redshift", "snowflake"):
                raise Invalid("no dollar quotes")
            self.rest("function")
            return
        if self.d == "tsql":
            if "as" not in rest and "begin" not in rest:
                raise Invalid("no body")
        at = self.body(rest)
        if at is not None:
            self.i += at
            if self.d == "tsql":
                return self.steps("$")
            if self.now != "begin":
                return self.step()
            return self.blocks()
        depth = 0
        for w in rest:
            depth += (w == "(") - (w == ")")
        if depth or not rest or rest[-1] in (",", "=", "(", ".", "and", "or", "where", "from"):
            raise Invalid("cut short")
        if "begin" in rest and "end" not in rest:
            raise Invalid("no END")
        self.i = len(self.w) - 1

    def body(self, rest: list[str]) -> int | None:
        """Where the statements of a routine begin; None where its body is a string, an expression or a call."""
        depth, trigger = 0, self.w[self.i - 1] == "trigger"
        for k, w in enumerate(rest):
            depth += (w == "(") - (w == ")")
            if depth:
                continue
            after = rest[k + 1] if k + 1 < len(rest) else "$"
            if self.d == "tsql" and w == "as" and (after in _STEPS or after == "("):
                return k + 1
            if self.d != "tsql" and w == "begin":
                return k
            if self.d == "mysql" and after in _STEPS - {"begin"} and (trigger and w == "row" or not trigger and w in (")", "i", "n") and k):
                return k + 1
        return None

    def blocks(self) -> None:
        """Declarations and blocks in turn, to the end of the text or of the statement."""
        while self.now != "$":
            while self.now not in ("begin", "$"):
                self.i += 1
            if self.take("$") or self.now == "$":
                return
            self.step()
            if self.now == ";" and "begin" not in self.w[self.i :]:
                return

    def opens_block(self) -> bool:
        """Whether BEGIN here opens a block, not a transaction."""
        after = self.peek()
        if after in (";", "$", "transaction", "tran") or self.d in ("sqlite", "postgresql", "redshift", ""):
            return False
        return not (self.d == "mysql" and after == "i" and self.peek(2) in (";", "$"))

    def steps(self, *ends: str) -> None:
        """The statements of a block, up to a word that ends it."""
        while self.now not in ends:
            if self.now == "$":
                raise Invalid("a block never ends")
            if self.take(";"):
                continue
            self.step()
            if self.now not in ends and self.d != "tsql":
                self.need(";")

    def step(self) -> None:
        """One statement within a block, control flow included."""
        w = self.now
        if w == "<<":
            self.i += 3
            return self.step()
        if self.is_name(w) and self.peek() == ":" and self.peek(2) in ("begin", "loop", "while", "repeat"):
            self.i += 2
            return self.step()
        if w == "begin" and self.peek() not in (";", "transaction", "tran"):
            self.i += 1
            kind = self.w[self.i - 1] if self.take("try", "catch") else ""
            if self.now == "i" and self.peek() in _STEPS:
                self.i += 1  # ATOMIC
            self.steps("end", "exception")
            if self.take("exception"):
                while self.take("when"):
                    self.until("then")
                    self.steps("when", "end")
            self.need("end")
            if kind:
                self.need(kind)
            elif self.is_name(self.now) and self.d != "tsql" and self.now not in _STEPS:
                self.i += 1
        elif w == "if" and self.d != "tsql":
            self.i += 1
            self.expr()
            self.need("then")
            self.steps("elsif", "elseif", "else", "end")
            while self.take("elsif", "elseif"):
                self.expr()
                self.need("then")
                self.steps("elsif", "elseif", "else", "end")
            if self.take("else"):
                self.steps("end")
            self.need("end")
            self.need("if")
        elif w in ("if", "while") and self.d == "tsql":
            self.i += 1
            self.expr()
            self.step()
            if w == "if":
                if self.now == ";" and self.peek() == "else":
                    self.i += 1
                if self.take("else"):
                    self.step()
        elif w == "case":
            self.i += 1
            if self.now != "when":
                self.expr()
            while self.take("when"):
                self.expr()
                self.need("then")
                self.steps("when", "else", "end")
            if self.take("else"):
                self.steps("end")
            self.need("end")
            self.need("case")
        elif w in ("while", "for", "loop", "repeat"):
            self.i += 1
            if w in ("while", "for"):
                self.until("loop", "do")
            self.steps("end", "until")
            if self.take("until"):
                self.until("end", keep=True)
            self.need("end")
            self.need("loop", "while", "for", "repeat")
            if self.is_name(self.now):
                self.i += 1
        elif w in ("select", "with", "values", "(", "insert", "update", "delete", "merge", "replace", "create", "explain"):
            self.statement()
            if self.take("into"):
                self.comma_list(self.target)
        elif w in _STEPS or w in _HEADS or w == "null":
            self.i += 1
            self.skim(w)
        elif (self.is_name(w) or w == "v") and self.peek() in (":=", "=", "(", ".", "[", ";", "end"):
            self.i += 1
            self.skim(w)
        else:
            raise Invalid(f"a statement of a block can't begin with {w}")

    def target(self) -> None:
        if not self.take("v"):
            self.dotted()

    def until(self, *words: str, keep: bool = False) -> None:
        """Skip to one of the words, outside brackets, and past it unless kept."""
        depth, n = 0, 0
        while depth or self.now not in words:
            if self.now in ("$", ";"):
                raise Invalid(f"no {words[0]}")
            depth += (self.now == "(") - (self.now == ")")
            n += 1
            self.i += 1
        if not n:
            raise Invalid("nothing between")
        self.i += not keep

    def skim(self, head: str) -> None:
        """Assignments, calls, declarations and their like: balanced words with a whole end."""
        depth, cases, last = 0, 0, head
        while self.now != "$":
            w = self.now
            if not depth and not cases:
                if w in (";", "end") or w in ("else", "elsif", "elseif", "exception") and last not in ("declare",):
                    break
                if self.d == "tsql" and w in _STEPS and w not in ("for", "loop", "repeat", "case", "with", "values") and head not in ("alter", "grant", "revoke") and last not in (",", "=", "for"):
                    break
                if w == "select" and last == "for":
                    break
            depth += (w == "(") - (w == ")")
            cases += (w == "case") - (w == "end")
            if depth < 0:
                raise Invalid("a bracket too many")
            last = w
            self.i += 1
        if depth or cases or last in (",", ".", "=", ":=", "+", "-", "(", "||", "and", "or", "where", "from"):
            raise Invalid("cut short")
        if last == "for" and self.now == "select":
            self.query()

    def explain(self) -> None:
        """EXPLAIN with its options, and the statement explained."""
        self.need("explain")
        if self.now == "(" and self.peek() not in ("select", "with", "values", "("):
            self.brackets()
        n = 0
        while self.now in ("analyze", "i", "for", "using", "=", "s") and n < 6 and self.peek() not in ("$", ";", "."):
            n += 1
            self.i += 1
        if self.now in ("select", "with", "values", "(", "insert", "update", "delete", "merge", "replace", "create"):
            self.statement()
        elif self.d == "tsql" or self.now in ("$", ";"):
            raise Invalid("EXPLAIN what")
        else:
            self.rest("explain")

    def index(self) -> None:
        """CREATE INDEX after the word INDEX."""
        if self.now == "i" and self.peek() in ("if", "i", "q", "on") and self.peek(2) != ".":
            self.i += self.peek() != "on"
        self.if_exists()
        if self.now != "on":
            self.dotted()
        if self.take("using"):
            self.name()
        self.need("on")
        self.take("only")
        self.dotted()
        if self.take("using"):
            self.name()
        if self.now == "(":
            self.i += 1
            self.comma_list(self.index_item)
            self.need(")")
        elif self.d not in ("tsql", "bigquery", "snowflake"):
            raise Invalid("no columns")
        while self.now not in ("$", ";"):
            if self.take("where"):
                self.expr()
            elif self.now == "(":
                self.brackets()
            elif self.now in (")", "select", "from", "and", "or", "then"):
                raise Invalid("an index never ends")
            else:
                self.i += 1
        if self.w[self.i - 1] in (",", "=", "."):
            raise Invalid("cut short")

    def index_item(self) -> None:
        self.expr()
        if self.take("collate"):
            self.dotted()
        while self.take("i"):  # an operator class
            if self.now == "(":
                self.brackets()
        self.take("asc", "desc")
        if self.take("nulls"):
            self.need("first", "last")


# Kinds of objects that are dropped and altered.
_KINDS = frozenset(
    x.strip()
    for x in """table, view, materialized view, index, schema, database, sequence, function, procedure, proc, trigger, user, role, login, type, domain, extension, package, package body, synonym, policy, rule, aggregate, operator,
    operator class, operator family, cast, collation, conversion, server, foreign data wrapper, user mapping, event, event trigger, stage, stream, task, pipe, warehouse, file format, share, tablespace, profile, directory, database link,
    credential, certificate, symmetric key, asymmetric key, master key, assembly, fulltext index, fulltext catalog, statistics, model, row access policy, masking policy, search index, vector index, table function, external function,
    snapshot table, capacity, reservation, assignment, library, context, cluster, publication, subscription, text search configuration, transform, access method, language, tag, network policy, integration, storage integration,
    resource monitor, application role, database role, partition function, partition scheme, security policy, service, queue, contract, group, datashare, identity provider, large object, routine, view log, materialized view log,
    dynamic table, alert, secret, connection, availability group, endpoint, server audit, server role, default, rollback segment, dimension, outline, resource group, logfile group, instance, account, organization, project, bi_capacity""".split(",")
)
_DROP_TAIL = frozenset("cascade restrict constraints purge force including contents and datafiles keep online offline wait nowait validate".split())
_TRUNCATE_TAIL = frozenset("restart continue identity cascade restrict drop reuse storage all preserve purge materialized view log with partition partitions".split())
#: Words behind the name of a table that has no list of columns.
_TABLE_TAIL = frozenset("as select with like clone using of on partition stored options cluster comment engine copy inherits tablespace diststyle distkey sortkey location for shallow deep external default".split())
#: Words with which options of an account begin.
_ACCOUNT = frozenset(
    """with identified password login nologin superuser nosuperuser createdb nocreatedb createrole nocreaterole inherit noinherit replication noreplication bypassrls nobypassrls connection in role admin user valid
    encrypted unencrypted default from for without profile quota account require sysid comment must_change_password not authorization nocreateuser createuser session syslog externalid temporary attribute container
    enable disable group if local external collate""".split()
)
#: Words with which an action of ALTER TABLE begins.
_ACTIONS = frozenset(
    """add drop alter modify change rename set owner enable disable validate attach detach cluster inherit no reset convert engine auto_increment comment default order truncate exchange merge split move shrink switch rebuild with
    check nocheck append swap replica force noforce read logging nologging cache nocache parallel noparallel compress nocompress discard import analyze coalesce reorganize optimize remove partition row_format checksum algorithm
    lock character charset collate storage using without of not clone suspend resume recluster unset upgrade pctfree pctused initrans allocate deallocate monitoring nomonitoring rowdependencies result_cache flashback indexing max_rows min_rows key_block_size
    first after deferred distkey encode""".split()
)
#: Words that a column's constraints and properties begin with.
_COLUMN = frozenset(
    """not null default primary key unique references check constraint collate generated always as identity auto_increment autoincrement comment on encode distkey sortkey virtual stored persisted using invisible visible options masking
    policy tag storage compression sparse rowguidcol encrypted character charset unsigned signed zerofill binary ascii unicode match full partial simple deferrable initially deferred immediate enable disable novalidate validate rely norely
    enforced hidden column_format by asc desc index clustered nonclustered with seed noorder order srid statistics set local global inherit sort enforce""".split()
)
_COLUMN_NAMED = frozenset("collate comment encode storage compression tag charset constraint column_format policy srid".split())
#: Words behind the name of a routine or trigger.
_ROUTINE = {
    "function": frozenset("return returns as is begin language authid deterministic with external immutable volatile stable comment sql security aggregate pipelined result_cache parallel_enable options remote using".split()),
    "procedure": frozenset("as is begin language authid deterministic with for returns comment sql security options external using select insert update delete set call declare if while return accessible not reads modifies contains no".split()),
    "trigger": frozenset("before after instead on for compound follows precedes enable disable insert update delete when with of referencing".split()),
}

#: Words that begin a statement within a block, besides names.
_STEPS = frozenset(
    """begin if while for loop repeat case select with values insert update delete merge replace create declare set return exec execute call
    perform raise raiserror open close fetch exit leave iterate continue signal resignal print throw waitfor deallocate let savepoint commit
    rollback alter drop truncate grant revoke get""".split()
)
_NO_ALIAS = frozenset(
    """against qualify window fetch for returning conflict output option tablesample pivot unpivot natural limit offset connect
    start minus apply lateral with partition over within filter collate asc desc nulls escape ilike rlike regexp glob similar
    isnull notnull use ignore sample do when default""".split()
)
#: Heads of administrative statements, by the dialects that know them; () stands for all.
_HEADS: dict[str, tuple[str, ...]] = {
    "alter": (), "drop": (), "truncate": (), "grant": (), "revoke": (), "begin": (), "commit": (), "rollback": (), "set": (),
    "explain": (), "analyze": (), "comment": (), "call": (), "lock": (), "start": (), "use": (), "reset": (), "show": (),
    "describe": ("mysql", "oracle", "snowflake"), "vacuum": ("postgresql", "sqlite", "redshift"),
    "declare": ("postgresql", "mysql", "tsql", "oracle", "snowflake", "bigquery", "redshift"), "exec": ("tsql", "oracle"), "execute": (), "copy": ("postgresql", "redshift", "snowflake"), "attach": ("sqlite",),
    "detach": ("sqlite",), "pragma": ("sqlite",), "change": ("mysql",), "unload": ("redshift",), "put": ("snowflake",),
    "get": ("snowflake",), "list": ("snowflake",), "go": ("tsql",), "return": ("tsql",), "do": ("postgresql", "mysql"), "if": ("tsql", "bigquery", "snowflake"),
    "end": ("tsql", "postgresql", "redshift", "sqlite"), "replace": (),
}
_CREATE: dict[str, tuple[str, ...]] = {
    "user": (), "role": (), "schema": (), "database": (), "sequence": (), "login": ("tsql",), "credential": ("tsql",),
    "type": (), "domain": ("postgresql",), "extension": ("postgresql",), "mapping": ("postgresql",), "trigger": (),
}


#: Words whose statements are told by the spelling of names too, not by their shape alone.
HEADS = frozenset("create alter drop truncate grant revoke".split())
#: By dialect, words of queries that are keywords there and names elsewhere.
MARKS = {d: ("grouping", "rollup", "cube") for d in ("postgresql", "oracle", "sqlite", "snowflake", "")} | {
    "mysql": ("grouping", "rollup", "cube", "load"),
    "tsql": ("grouping", "rollup", "cube", " xml", " json"),
    "bigquery": ("grouping", "rollup", "cube", "|>"),
    "redshift": ("grouping", "rollup", "cube", "approximate"),
}


def valid(words: list[str], dialect: str, names: list[str] | None = None) -> bool:
    """Whether the shape is a script of the dialect; the empty shape is one. `names` has the same words as they are spelt."""
    limit = sys.getrecursionlimit()
    # A call of the parser takes no room on the machine's stack, only on the heap, and none goes on
    # without taking a word or two: so deep that no text meets the limit.
    sys.setrecursionlimit(max(limit, 2_000 + FRAMES_A_WORD * len(words)))
    try:
        Parser(words, dialect, names).script()
    except (Invalid, IndexError):
        return False
    finally:
        sys.setrecursionlimit(limit)
    return True
