"""Scripts into statements, templates into SQL of equal length, text into typed tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PIECE = re.compile(
    r"(?P<blank>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quote>'(?:[^']|'')*(?:'|\Z)|\"(?:[^\"]|\"\")*(?:\"|\Z)|`(?:[^`]|``)*(?:`|\Z)|\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z))"
    r"|(?P<word>[^\W\d_]\w*)|(?P<end>;)|(?P<other>.)",
    re.DOTALL,
)


def split(text: str) -> list[tuple[str, int, int, int, int]]:
    """(raw, start_offset, end_offset, line, column) of each statement; lines and columns from 1.

    A semicolon ends a statement unless it stands in quotes, comments, dollar quotes or between
    BEGIN or CASE and its END, and belongs to it. White space and comments before a statement are
    no part of it.
    """
    out: list[tuple[str, int, int, int, int]] = []
    begun, last, depth = -1, 0, 0

    def close(end: int) -> None:
        before = text.rfind("\n", 0, begun)
        out.append((text[begun:end], begun, end, text.count("\n", 0, begun) + 1, begun - before))

    for m in _PIECE.finditer(text):
        kind = m.lastgroup if m.lastgroup != "tag" else "quote"
        if kind == "blank":
            if begun >= 0 and not m.group().isspace():
                last = m.end()
            continue
        if begun < 0:
            begun = m.start()
        last = m.end()
        if kind == "word":
            word = m.group().upper()
            if word in ("BEGIN", "CASE"):
                depth += 1
            elif word == "END":
                depth = max(0, depth - 1)
        elif kind == "end" and depth == 0:
            close(m.end())
            begun = -1
    if begun >= 0:
        close(len(text[:last].rstrip()))
    return out


def without_templates(text: str) -> str:
    """Template comments and blocks as spaces, expressions as a name, all of the same length."""
    text = re.sub(r"\{#.*?#\}|\{%.*?%\}", lambda m: " " * len(m.group()), text, flags=re.DOTALL)
    name = "__jinja"
    return re.sub(r"\{\{.*?\}\}", lambda m: name.ljust(len(m.group()), "_") if len(m.group()) > len(name) else "x" * len(m.group()), text, flags=re.DOTALL)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "query_index", "raw", "start_offset", "end_offset", "line_no", "col_no"]
    for pdf in batches:
        rows = []
        for file, content in zip(pdf["file"], pdf["content"]):
            if not content:
                continue
            for k, (_, start, end, line, column) in enumerate(split(without_templates(content))):
                rows.append((file, k, content[start:end], start, end, line, column))
        yield pd.DataFrame(rows, columns=columns)


def split_sources(sources: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """file, query_index, raw, start_offset, end_offset, line_no, col_no of every statement of every source.

    Null, empty and comment-only contents have none; contents are taken whole; template syntax is
    looked through, but `raw` keeps it; an empty table gives an empty result.
    """
    chosen = sources.select(F.col(file).alias("file"), F.col(content).alias("content"))
    return chosen.mapInPandas(_split, "file string, query_index int, raw string, start_offset int, end_offset int, line_no int, col_no int")


def location(text: Column, offset: Column) -> Column:
    """line and column, from 1, of a character offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.struct((F.regexp_count(before, F.lit("\n")) + 1).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


# ---------------------------------------------------------------------------------------------
# Tokens, within the JVM

# Token types, in the order that decides, with the form that each begins with.
TOKEN_TYPES = [
    ("COMMENT", r"--[^\n]*|/\*(?s:.*?)\*/"),
    ("STRING", r"'(?:[^']|'')*'"),
    ("QUOTED_NAME", r'"(?:[^"]|"")*"|`[^`]*`'),
    ("NUMBER", r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"),
    ("PLACEHOLDER", r"[?]|[:@$]\w+|%s"),
    ("OPERATOR", r"<=>|<=|>=|<>|!=|\|\||::|[-+*/%=<>&|^~]"),
    ("PUNCTUATION", r"[(),;.\[\]{}]"),
    ("WHITESPACE", r"\s+"),
    ("WORD", r"[A-Za-z_][A-Za-z0-9_$]*"),
    ("UNKNOWN", r"[\s\S]"),
]
_ALL = "|".join(f"(?:{p})" for _, p in TOKEN_TYPES)
_ALL_RE2 = _ALL.replace("(?s:.*?)", r"[\s\S]*?")

# Words that are keywords, and literals spelt as words.
KEYWORDS = """SELECT FROM WHERE AND OR NOT IN IS AS ON JOIN LEFT RIGHT INNER OUTER FULL CROSS GROUP ORDER BY HAVING LIMIT OFFSET UNION ALL DISTINCT INSERT INTO VALUES UPDATE
SET DELETE CREATE TABLE VIEW INDEX DROP ALTER CASE WHEN THEN ELSE END EXISTS BETWEEN LIKE WITH RECURSIVE ASC DESC COUNT SUM AVG MIN MAX PRIMARY KEY FOREIGN REFERENCES
INTEGER INT BIGINT VARCHAR DECIMAL BOOLEAN TIMESTAMP DATE DECLARE BEGIN RETURN FUNCTION PROCEDURE EXEC MERGE USING GRANT REVOKE TOP OVER PARTITION""".split()


def token_type(token: Column) -> Column:
    upper = F.upper(token)
    out = F.when(upper == "NULL", "NULL").when(upper.isin("TRUE", "FALSE"), "BOOLEAN").when(upper.isin(*KEYWORDS), "KEYWORD")
    for name, pattern in TOKEN_TYPES:
        out = out.when(token.rlike(f"^(?:{pattern})$"), "IDENTIFIER" if name == "WORD" else name)
    return out.otherwise("UNKNOWN")


def tokens(statements: DataFrame, key: str, text: str = "raw") -> DataFrame:
    """key, position, token, type, start_offset of every token, white space and comments included.

    Null and empty texts have none. Every character belongs to one token.
    """
    each = statements.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).alias("position", "token"))
    before = F.sum(F.length("token")).over(Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return each.select(key, "position", "token", token_type(F.col("token")).alias("type"), F.coalesce(before, F.lit(0)).alias("start_offset"))


def significant(found: DataFrame) -> DataFrame:
    """Tokens without white space and comments."""
    return found.filter(~F.col("type").isin("WHITESPACE", "COMMENT"))


def tokens_sql() -> str:
    """The same for another engine, over the statements table."""
    quoted = _ALL_RE2.replace("'", "''")
    whens = " ".join("WHEN regexp_full_match(token, '{}') THEN '{}'".format(p.replace("(?s:.*?)", r"[\s\S]*?").replace("'", "''"), "IDENTIFIER" if n == "WORD" else n) for n, p in TOKEN_TYPES)
    keywords = ", ".join(f"'{k}'" for k in KEYWORDS)
    return f"""a AS (SELECT stmt_id, regexp_extract_all(raw, '{quoted}') AS ts FROM statements WHERE raw IS NOT NULL),
t AS (SELECT stmt_id, unnest(ts) AS token FROM a),
typed AS (SELECT stmt_id, token, CASE WHEN upper(token) = 'NULL' THEN 'NULL' WHEN upper(token) IN ('TRUE', 'FALSE') THEN 'BOOLEAN' WHEN upper(token) IN ({keywords}) THEN 'KEYWORD' {whens} ELSE 'UNKNOWN' END AS type FROM t)"""


def statement_type(raw: Column) -> Column:
    """The first word of the statement; WITH counts as SELECT."""
    word = F.upper(F.regexp_extract(raw, r"^(?:\s|--[^\n]*\n|/\*[\s\S]*?\*/)*([A-Za-z]+)", 1))
    return F.when(word == "WITH", "SELECT").when(word == "", None).otherwise(word)


def is_ddl(kind: Column) -> Column:
    return F.coalesce(kind.isin("CREATE", "ALTER", "DROP", "TRUNCATE"), F.lit(False))
