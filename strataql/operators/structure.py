"""The structure of statements: frames (a SELECT or another statement head) with their clauses.

One scan over a statement's tokens tracks brackets, clauses and nested SELECTs and gives an array
of frames for each statement, tolerant of text that doesn't parse. Rules are Column expressions on
that array, so nothing is joined or shuffled to evaluate them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataql.session import spread

_TOKEN = re.compile(
    r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)|"(?:[^"]|"")*(?:"|\Z)|`[^`]*(?:`|\Z)|\[[A-Za-z_][^\]\n]*\]"""
    r"|\{\{.*?\}\}|\{%.*?%\}|[@:$\#]{1,2}\w+|\d+(?:\.\d+)?|[A-Za-z_][\w$]*|<=>|<=|>=|<>|!=|\|\||::|->>|->|\S",
    re.DOTALL,
)

# Functions that aggregate.
AGGREGATES = frozenset("COUNT SUM AVG MIN MAX STDDEV VARIANCE GROUP_CONCAT STRING_AGG ARRAY_AGG LISTAGG MEDIAN STDDEV_POP STDDEV_SAMP VAR_POP VAR_SAMP".split())
_CLAUSES = {"FROM": "from", "WHERE": "where", "HAVING": "having", "LIMIT": "limit", "OFFSET": "offset", "SET": "set", "VALUES": "values", "RETURNING": "returning", "QUALIFY": "qualify"}
_NO_NAME = frozenset(
    """SELECT FROM WHERE AND OR NOT IN IS NULL AS ON JOIN LEFT RIGHT INNER OUTER FULL CROSS NATURAL USING GROUP ORDER BY HAVING LIMIT OFFSET FETCH UNION ALL
    EXCEPT INTERSECT INSERT INTO VALUES UPDATE SET DELETE CASE WHEN THEN ELSE END DISTINCT LIKE ILIKE BETWEEN EXISTS WITH RECURSIVE TOP ASC DESC NULLS FIRST LAST ONLY
    ROWS ROW NEXT OVER PARTITION RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT TRUE FALSE INTERVAL CAST RETURNING QUALIFY LATERAL FOR ESCAPE COLLATE DUPLICATE KEY DO
    NOTHING CONFLICT OVERWRITE MERGE MATCHED TABLE ANY SOME WINDOW DEFAULT PRIMARY FOREIGN REFERENCES CONSTRAINT CHECK UNIQUE""".split()
)

FRAME = """id int, parent int, depth int, kind string, role string, distinct boolean, star boolean, any_star boolean, n_projections int, projected array<string>,
tables array<string>, dbs array<string>, table_aliases array<string>, aliases array<string>, joins array<string>, left_aliases array<string>, n_from int,
has_where boolean, where_cols array<string>, where_func boolean, where_text string, has_group boolean, group_cols array<string>, has_having boolean,
has_order boolean, order_cols array<string>, has_limit boolean, has_offset boolean, offset_value bigint, aggs array<string>, funcs array<string>, bare_windows int,
max_in int, not_in_select boolean, n_not int, n_neq int, or_apart int, eqs array<string>, likes array<string>, open_cases int, case_depth int, n_and int, n_or int,
n_subqueries int, sub_depth int, qualifiers array<string>, self_cte boolean, columns array<string>, insert_cols array<string>, insert_from string, set_cols array<string>,
self_assign boolean, object_kind string, object_name string, coldefs array<string>, fk_cols array<string>, indexed_cols array<string>, grant_all boolean, lt_cols array<string>, reserved boolean"""

# Words that shouldn't name a column or table.
RESERVED_NAMES = frozenset("ORDER GROUP BY SELECT FROM WHERE TABLE INDEX USER DATE KEY COLUMN AS JOIN LIMIT OFFSET".split())


def words(text: str) -> list[str]:
    """Tokens without white space and comments."""
    return [t for t in _TOKEN.findall(text) if t[:2] not in ("--", "/*") and t[:2] != "{%"]


def bare(token: str) -> str:
    if token[:2] == "{{":
        return "__jinja__"
    return token[1:-1] if token[0] in "\"`[" and len(token) > 1 else token


def _is_name(token: str) -> bool:
    return token[0] in '"`[{' and len(token) > 1 or (token[0].isalpha() or token[0] == "_") and token.upper() not in _NO_NAME


def _new(fid: int, parent: int, depth: int, kind: str, role: str) -> dict:
    f: dict = {"id": fid, "parent": parent, "depth": depth, "kind": kind, "role": role, "clause": "projection" if kind == "SELECT" else "head", "object_kind": None, "object_name": None, "where_text": None, "insert_from": None, "offset_value": None}
    for name in ("projected", "tables", "dbs", "table_aliases", "aliases", "joins", "left_aliases", "where_cols", "group_cols", "order_cols", "aggs", "funcs", "eqs", "likes", "qualifiers", "columns", "insert_cols", "set_cols", "coldefs", "fk_cols", "indexed_cols", "lt_cols", "refs"):
        f[name] = []
    for name in ("distinct", "star", "any_star", "has_where", "where_func", "has_group", "has_having", "has_order", "has_limit", "has_offset", "not_in_select", "self_cte", "self_assign", "grant_all", "reserved"):
        f[name] = False
    for name in ("bare_windows", "max_in", "n_not", "n_neq", "or_apart", "open_cases", "case_depth", "n_and", "n_or", "n_subqueries", "sub_depth"):
        f[name] = 0
    f["n_projections"] = 1 if kind == "SELECT" else 0
    f["n_from"] = 0
    f["_where"] = []
    return f


_HEADS = frozenset("UPDATE DELETE INSERT MERGE CREATE DROP ALTER TRUNCATE GRANT REVOKE REPLACE".split())


def frames(text: str) -> list[dict]:
    """The frames of one statement, in the order in which they begin."""
    return _frames(words(text))


def _frames(w: list[str]) -> list[dict]:
    n = len(w)
    up = [t.upper() for t in w]
    out: list[dict] = []
    stack: list[tuple[dict | None, str, str]] = []  # (frame before the bracket, what the bracket is, that frame's clause)
    now: dict | None = None
    cases: list[list] = []
    level = _levels(w, up)
    within = None  # told when a bracket first asks

    def begin(kind: str, role: str) -> dict:
        parent = next((f["id"] for f, _, _ in reversed(stack) if f is not None), -1) if role != "root" else -1
        depth = sum(1 for _, r, _ in stack if r == "subquery")
        f = _new(len(out), parent, depth, kind, role)
        out.append(f)
        return f

    i = 0
    while i < n:
        t, u = w[i], up[i]
        nxt = up[i + 1] if i + 1 < n else ""
        if u == "(":
            role = "group"
            if within is None and i and up[i - 1] not in ("AS", "FROM", "JOIN", "VALUES", ","):
                within = _brackets(w, up)
            if nxt in ("SELECT", "WITH"):
                role = "cte" if i and up[i - 1] in ("AS", "MATERIALIZED") and now is None else "subquery"
                if role == "subquery" and now is not None:
                    now["n_subqueries"] += 1
                    if i and up[i - 1] == "IN" and i > 1 and up[i - 2] == "NOT":
                        now["not_in_select"] = True
            elif i and up[i - 1] == "OVER":
                role = "over"
                if now is not None and not within[0].get(i):
                    now["bare_windows"] += 1
            elif i and up[i - 1] == "IN" and now is not None:
                now["max_in"] = max(now["max_in"], within[1].get(i, 0))
            elif i and _is_name(w[i - 1]) and w[i - 1][0] not in "\"`[" and now is not None and not (now["kind"] in ("INSERT", "CREATE") and now["clause"] in ("head", "into")):
                name = up[i - 1]
                now["funcs"].append(name)
                if name in AGGREGATES:
                    now["aggs"].append(name)
                if now["clause"] == "where" and within[2].get(i):
                    now["where_func"] = True
                role = "call"
            stack.append((now, role, now["clause"] if now is not None else ""))
            if role == "over" and now is not None:
                now["clause"] = "over"
            if role in ("cte", "subquery"):
                now_role = role
                i += 1
                if up[i] == "WITH":
                    i += 1
                    continue
                now = begin("SELECT", now_role)
                i += 1
                continue
        elif u == ")":
            if stack:
                before, role, clause = stack.pop()
                if before is not None:
                    before["clause"] = clause
                if role in ("cte", "subquery"):
                    inner = now
                    now = before
                    if role == "subquery" and before is not None and inner is not None:
                        before["sub_depth"] = max(before["sub_depth"], inner["sub_depth"] + 1)
        elif u == "SELECT":
            role = "setop" if i and (up[i - 1] in ("UNION", "ALL", "EXCEPT", "INTERSECT", "MINUS") and now is not None and now["kind"] == "SELECT") else ("root" if now is None or now["kind"] != "SELECT" and now["kind"] != "INSERT" and now["kind"] != "CREATE" else "body")
            if now is not None and now["kind"] in ("INSERT", "CREATE"):
                now["insert_from"] = "select"
                role = "body"
            now = begin("SELECT", role)
        elif u in _HEADS and (now is None or (i and w[i - 1] == ";")) and not stack:
            now = begin(u, "root")
            if u in ("CREATE", "DROP", "ALTER", "TRUNCATE"):
                j = i + 1
                while j < n and up[j] in ("OR", "REPLACE", "TEMPORARY", "TEMP", "UNIQUE", "MATERIALIZED", "GLOBAL", "LOCAL", "CLUSTERED"):
                    j += 1
                if j < n:
                    now["object_kind"] = up[j]
                    k = j + 1
                    while k < n and up[k] in ("IF", "NOT", "EXISTS"):
                        k += 1
                    while k + 2 < n and w[k + 1] == ".":
                        k += 2
                    if k < n and _is_name(w[k]):
                        now["object_name"] = bare(w[k]).lower()
                    if u == "CREATE" and up[j] == "TABLE":
                        _table_items(w, up, k + 1, now)
            elif u == "GRANT":
                now["grant_all"] = nxt == "ALL"
            elif u == "INSERT" or u == "REPLACE":
                _insert_head(w, up, i, now)
            elif u == "UPDATE":
                now["clause"] = "from"
                now["n_from"] = 1
        elif u == ";" and not stack:
            now = None
        elif now is not None:
            _word(w, up, i, now, cases, level)
        i += 1
    for f in out:
        f["where_text"] = " ".join(f.pop("_where")) or None
        f.pop("clause")
    _recursion(w, up, out)
    return out


def _ctes(w: list[str], up: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Where the brackets of each common table expression are, by its lower-case name."""
    out: dict[str, list[tuple[int, int]]] = {}
    open_now: list[tuple[int, str]] = []
    for i, t in enumerate(w):
        if t == "(":
            is_cte = i > 1 and up[i - 1] == "AS" and _is_name(w[i - 2]) and i > 2 and up[i - 3] in ("WITH", "RECURSIVE", ",")
            open_now.append((i, bare(w[i - 2]).lower() if is_cte else ""))
        elif t == ")" and open_now:
            at, name = open_now.pop()
            if name:
                out.setdefault(name, []).append((at, i))
    for at, name in open_now:
        if name:
            out.setdefault(name, []).append((at, len(w)))
    return out


def _recursion(w: list[str], up: list[str], out: list[dict]) -> None:
    """A CTE that reads itself, anywhere within its own brackets."""
    ctes = _ctes(w, up)
    if not ctes or not out:
        return
    for j in range(len(w) - 1):
        if up[j] in ("FROM", "JOIN") and any(a < j <= b for a, b in ctes.get(bare(w[j + 1]).lower(), ())):
            out[0]["self_cte"] = True
            return


def _word(w: list[str], up: list[str], i: int, now: dict, cases: list, level: list[int]) -> None:
    t, u = w[i], up[i]
    n = len(w)
    prev, nxt = up[i - 1] if i else "", up[i + 1] if i + 1 < n else ""
    clause = now["clause"]
    if clause == "over":
        if _is_name(t) and nxt not in ("(", "."):
            now["columns"].append(bare(t).lower())
        return
    if u in _CLAUSES and not (u == "SET" and now["kind"] not in ("UPDATE", "MERGE", "INSERT")) and not (u == "FROM" and prev == "DISTINCT"):
        if u == "FROM" and now["kind"] == "SELECT" and clause not in ("projection",):
            return
        now["clause"] = _CLAUSES[u]
        if u == "FROM":
            now["n_from"] = 1
        elif u == "WHERE":
            now["has_where"] = True
        elif u == "HAVING":
            now["has_having"] = True
        elif u == "LIMIT":
            now["has_limit"] = True
        elif u == "OFFSET":
            now["has_offset"] = True
            if nxt.isdigit():
                now["offset_value"] = int(nxt)
        elif u == "VALUES":
            now["insert_from"] = "values"
        return
    if u in ("GROUP", "ORDER") and nxt == "BY":
        now["clause"] = u.lower()
        now["has_" + u.lower()] = True
        return
    if u == "FETCH" or u == "TOP" and prev in ("SELECT", "DISTINCT"):
        now["has_limit"] = True
        return
    if u == "DISTINCT" and prev == "SELECT":
        now["distinct"] = True
        return
    if clause == "where":
        now["_where"].append(u)
    if u == "CASE":
        cases.append([now, False])
        now["case_depth"] = max(now["case_depth"], len(cases))
    elif u == "ELSE" and cases:
        cases[-1][1] = True
    elif u == "END" and cases:
        owner, has_else = cases.pop()
        owner["open_cases"] += not has_else
    elif u == "AND":
        now["n_and"] += clause in ("where", "having", "from")
    elif u == "OR":
        now["n_or"] += 1
        left, right = _operand_column(w, i, -1), _operand_column(w, i, 1)
        now["or_apart"] += bool(left and right and left != right)
    elif u == "NOT":
        now["n_not"] += prev != "IS"
    elif u in ("<>", "!="):
        now["n_neq"] += 1
    elif u == "*":
        direct = prev in ("SELECT", "DISTINCT", "ALL", ",", ".") and clause == "projection" and nxt in ("FROM", ",", "", ";", ")", "EXCEPT", "INTO")
        now["star"] = now["star"] or direct
        now["any_star"] = now["any_star"] or direct or prev == "("
    elif u == ",":
        if clause == "projection" and level[i] == 0:
            now["n_projections"] += 1
        elif clause == "from" and level[i] == 0:
            now["n_from"] += 1
    elif u in ("JOIN",):
        kind = next((up[k] for k in range(i - 1, max(-1, i - 4), -1) if up[k] in ("LEFT", "RIGHT", "FULL", "CROSS", "INNER", "NATURAL")), "INNER")
        if kind == "INNER" and prev not in ("INNER", "OUTER"):
            kind = prev if prev in ("CROSS", "NATURAL", "LEFT", "RIGHT", "FULL") else "INNER"
        now["joins"].append(kind)
    elif u in ("LIKE", "ILIKE") and i + 1 < n:
        now["likes"].append(w[i + 1][1:-1] if w[i + 1][0] == "'" else ("?" if w[i + 1][0] in "?:@$%" else ""))
    elif u in ("<", "<=") and clause == "where" and i and _is_name(w[i - 1]):
        now["lt_cols"].append(bare(w[i - 1]).lower())
    elif u == "=" and i + 1 < n and i and _is_name(w[i - 1]):
        col = bare(w[i - 1]).lower()
        if clause == "set":
            now["set_cols"].append(col)
            if i + 2 < n and bare(w[i + 1]).lower() == col and w[i + 2] in "+-":
                now["self_assign"] = True
        elif w[i + 1][0] == "'":
            now["eqs"].append(col + "=s")
        elif w[i + 1][0].isdigit():
            now["eqs"].append(col + "=n")
    elif u == "AS" and i + 1 < n and _is_name(w[i + 1]):
        now["aliases"].append(bare(w[i + 1]).lower())
    elif _is_name(t):
        _name(w, up, i, now, level)


def _levels(w: list[str], up: list[str]) -> list[int]:
    """For each token 0 where it stands directly in a statement or a query's own brackets, else 1."""
    out, open_now, now = [], [], 0
    for i, t in enumerate(w):
        if t == ")" and open_now:
            now = open_now.pop()
        out.append(now)
        if t == "(":
            open_now.append(now)
            now = 0 if i + 1 < len(w) and up[i + 1] in ("SELECT", "WITH") else 1
    return out


def _brackets(w: list[str], up: list[str]) -> tuple[dict, dict, dict]:
    """By opening bracket: whether PARTITION is within, literals directly before the first close, whether a bare name is within."""
    close: dict[int, int] = {}
    partitions, literal_count, names = [0], [0], [0]
    for i, t in enumerate(w):
        partitions.append(partitions[-1] + (up[i] == "PARTITION"))
        literal_count.append(literal_count[-1] + (t[0] == "'" or t[0].isdigit()))
        names.append(names[-1] + (_is_name(t) and (i + 1 >= len(w) or w[i + 1] != "(")))
    first_close = len(w)
    open_now: list[int] = []
    firsts: dict[int, int] = {}
    for i in range(len(w) - 1, -1, -1):
        if w[i] == ")":
            first_close = i
            open_now.append(i)
        elif w[i] == "(":
            close[i] = open_now.pop() if open_now else len(w)
            firsts[i] = first_close
    partitioned = {i: partitions[j] > partitions[i] for i, j in close.items()}
    literals = {i: literal_count[j] - literal_count[i] for i, j in firsts.items()}
    named = {i: names[j] > names[i] for i, j in close.items()}
    return partitioned, literals, named


def _operand_column(w: list[str], i: int, step: int) -> str:
    """The column of the comparison before (-1) or after (1) position i."""
    if step > 0:
        k = i + 1
        while k < len(w) and w[k] in ("(", "NOT", "not", "Not"):
            k += 1
    else:
        k = i - 1
        while k > 0 and (w[k] in (")",) or w[k][0] in "'0123456789?" or w[k] in ("=", "<", ">", "<=", ">=", "<>", "!=", "-", "+")):
            k -= 1
    if 0 <= k < len(w) and _is_name(w[k]):
        while step > 0 and k + 2 < len(w) and w[k + 1] == ".":
            k += 2
        return bare(w[k]).lower()
    return ""


def _name(w: list[str], up: list[str], i: int, now: dict, level: list[int]) -> None:
    n = len(w)
    prev, nxt = up[i - 1] if i else "", up[i + 1] if i + 1 < n else ""
    clause = now["clause"]
    name = bare(w[i])
    table_place = prev in ("FROM", "JOIN", "INTO", "UPDATE", "USING", "ONLY") or (clause == "from" and prev == "," and level[i] == 0 and "ON" not in up[max(0, i - 2) : i])
    if table_place or (prev == "TABLE" and now["kind"] in ("DROP", "TRUNCATE", "ALTER")):
        k, db = i, ""
        while k + 2 < n and w[k + 1] == ".":
            db, k = bare(w[k]), k + 2
        if k + 1 < n and w[k + 1] == "(" and prev not in ("INTO",):
            return
        now["tables"].append(bare(w[k]).lower())
        now["reserved"] = now["reserved"] or bare(w[k]).upper() in RESERVED_NAMES
        if db:
            now["dbs"].append(db.lower())
        a = k + 2 if k + 1 < n and up[k + 1] == "AS" else k + 1
        if a < n and _is_name(w[a]) and up[a] not in ("SET",):
            now["table_aliases"].append(bare(w[a]).lower())
            now["aliases"].append(bare(w[a]).lower())
            alias = bare(w[a]).lower()
        else:
            alias = bare(w[k]).lower()
        if now["joins"] and now["joins"][-1] == "LEFT" and prev == "JOIN":
            now["left_aliases"].append(alias)
        return
    if prev == "." and i > 1 and clause == "from" and up[max(0, i - 3)] in ("FROM", "JOIN", "INTO", "UPDATE", ","):
        return
    if nxt == "." :
        now["qualifiers"].append(name.lower())
        return
    if nxt == "(" or prev == "AS" or prev == "OVER":
        return
    if clause == "from" and prev not in ("ON", "AND", "OR", "=", "<", ">", "<=", ">=", "<>", "!=", "(", ".", ",", "+", "-") :
        return  # an alias
    if name.isdigit():
        return
    low = name.lower()
    now["reserved"] = now["reserved"] or name.upper() in RESERVED_NAMES
    if clause == "projection" and prev not in ("SELECT", "DISTINCT", "ALL", ",", ".", "(", "+", "-", "*", "/", "=", "<", ">", "||", "WHEN", "THEN", "ELSE", "CASE", "AND", "OR", "NOT", "BY"):
        now["aliases"].append(low)
        return
    now["columns"].append(low)
    now["refs"].append(_reference(w, up, i, low, clause))
    if clause == "projection" and level[i] == 0:
        now["projected"].append(low)
    elif clause == "where":
        now["where_cols"].append(low)
    elif clause == "group":
        now["group_cols"].append(low)
    elif clause == "order":
        now["order_cols"].append(low)


def _reference(w: list[str], up: list[str], i: int, name: str, clause: str) -> tuple[str, str, str, str | None, bool]:
    """(qualifier, column, clause, JSON key taken from it, whether it stands alone under an alias)."""
    qualifier = bare(w[i - 2]).lower() if i > 1 and w[i - 1] == "." else ""
    nxt = w[i + 1] if i + 1 < len(w) else ""
    key = bare_text(w[i + 2]) if nxt in ("->", "->>") and i + 2 < len(w) else None
    return qualifier, name, clause, key, clause == "projection" and (nxt.upper() == "AS" or bool(nxt) and _is_name(nxt))


def bare_text(token: str) -> str:
    return token[1:-1] if token[0] == "'" and len(token) > 1 else token


def _table_items(w: list[str], up: list[str], k: int, now: dict) -> None:
    """Columns, foreign keys and inline indexes of CREATE TABLE."""
    if k >= len(w) or w[k] != "(":
        return
    depth, item = 0, []
    for j in range(k, len(w)):
        t = w[j]
        depth += (t == "(") - (t == ")")
        if (t == "," and depth == 1) or depth == 0:
            _table_item(item, now)
            item = []
            if depth == 0:
                return
        elif j > k:
            item.append(t)


def _table_item(item: list[str], now: dict) -> None:
    if not item:
        return
    head = [x.upper() for x in item]
    inside = [bare(x).lower() for x in item[item.index("(") + 1 :]] if "(" in item else []
    listed = [x for x in inside[: inside.index(")")] if x != ","] if ")" in inside else []
    if "FOREIGN" in head:
        now["fk_cols"] += listed
    elif head[0] in ("INDEX", "KEY") or head[0] in ("PRIMARY", "UNIQUE"):
        now["indexed_cols"] += listed
    elif head[0] not in ("CONSTRAINT", "CHECK"):
        now["coldefs"].append(bare(item[0]).lower())
        if "REFERENCES" in head:
            now["fk_cols"].append(bare(item[0]).lower())
        if "PRIMARY" in head or "UNIQUE" in head:
            now["indexed_cols"].append(bare(item[0]).lower())


def _insert_head(w: list[str], up: list[str], i: int, now: dict) -> None:
    j = i + 1
    while j < len(w) and up[j] in ("INTO", "IGNORE", "OR", "REPLACE", "OVERWRITE", "TABLE"):
        j += 1
    k = j
    while k + 2 < len(w) and w[k + 1] == ".":
        k += 2
    if k + 1 < len(w) and w[k + 1] == "(" and not (k + 2 < len(w) and up[k + 2] in ("SELECT", "WITH")):
        m = k + 2
        while m < len(w) and w[m] != ")":
            if _is_name(w[m]):
                now["insert_cols"].append(bare(w[m]).lower())
            m += 1


_NAMES = [part.split()[0] for part in FRAME.replace("\n", " ").split(",") if part.strip()]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pdf.drop(columns=["raw"]).copy()
        out["raw"] = pdf["raw"]
        out["raw_upper"] = pdf["raw"].str.upper()
        out["frames"] = [[{k: f[k] for k in _NAMES} for f in frames(t)] if t else [] for t in pdf["raw"]]
        yield out


def structured(statements: DataFrame, carry: list[str], text: str = "raw") -> DataFrame:
    """The carried columns, `raw`, `raw_upper` and `frames` of every statement.

    Null and empty texts, comments and text that is no SQL have whatever frames can be seen, often
    none; texts are taken whole; repeated rows come out each; an empty table gives an empty result.
    """
    inner = [f"kept_{k}" for k in range(len(carry))]
    chosen = statements.select(*[F.col(c).alias(k) for k, c in zip(inner, carry)], F.col(text).alias("raw"))
    types = [f"{k} {statements.schema[c].dataType.simpleString()}" for k, c in zip(inner, carry)]
    fields = ", ".join(f"{p.split()[0]}:{p.split()[1]}" for p in FRAME.replace("\n", " ").split(",") if p.strip())
    out = spread(chosen).mapInPandas(_scan, ", ".join([*types, "raw string", "raw_upper string", f"frames array<struct<{fields}>>"]))
    return out.toDF(*carry, "raw", "raw_upper", "frames")


def nodes(structure: DataFrame, key: str) -> DataFrame:
    """One row for every frame of every statement: key, then the frame's fields."""
    return structure.select(key, F.explode("frames").alias("f")).select(key, "f.*")
