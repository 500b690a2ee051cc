"""The canonical form of a statement: equal for copies that differ in formatting only.

White space, letter case outside single quotes, quote marks and brackets around names and closing
semicolons don't count, nor does the order of a SELECT list, of the assignments after SET, or of an
INSERT column list moved together with its values.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"--[^\r\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)|\"(?:[^\"]|\"\")*(?:\"|\Z)|`[^`]*(?:`|\Z)|\[[^\]\[\d'\r\n][^\]\['\r\n]*\]"
    r"|\d+(?:\.\d+)?(?:e[+-]?\d+)?|\w+|<=>|->>|<=|>=|<>|!=|\|\||::|:=|=>|->|<<|>>|\S",
    re.DOTALL | re.IGNORECASE,
)
_BLANK = re.compile(r"\s+")
#: Joins tokens; can't occur within one, since tokens hold no such control sign outside quotes.
SEP = "\x1f"

#: Words that end a SELECT list or a SET list at the same bracket depth.
_LIST_END = frozenset("from into where group having order limit offset fetch union except intersect minus qualify window for returning when on bulk ;".split())
_SET_END = frozenset("where from returning output order limit when on ;".split())

#: Those of them that may also be plain names: behind a comma, a dot or the head of the list they are.
_SOFT_END = frozenset("limit offset fetch qualify window returning bulk minus".split())
_KNOWN = _LIST_END | _SET_END | frozenset("select set insert update values merge case end distinct all top as partition".split())
#: Stands before a quoted name that reads like one of these words, as long as lists are arranged.
_MARK = "\x1d"

#: Words between INSERT and its target.
_INSERT_WORDS = frozenset("or into overwrite table only ignore replace abort fail rollback low_priority high_priority delayed top".split())


class _Forms(dict):
    """Canonical spelling by token, filled on demand and emptied when it grows."""

    def __missing__(self, token: str) -> str:
        c = token[0]
        if c == "'":
            form = token
        elif c in '"`':
            form = _named(token.strip(c).lower()) if len(token) > 1 else token
        elif c == "[" and len(token) > 1:
            form = _named(token[1:-1].lower())
        elif token[:2] in ("--", "/*"):
            form = _BLANK.sub(" ", token.lower()).rstrip()
        else:
            form = token.lower()
        if len(self) > 200_000:
            self.clear()
        self[token] = form
        return form


def _named(name: str) -> str:
    return _MARK + name if name in _KNOWN else name


_forms = _Forms()


class _Group(str):
    """A bracketed part, already canonical, that still knows its comma-separated items."""

    items: list[list[str]]


def _split(words: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        if w == ",":
            out.append([])
        else:
            out[-1].append(w)
    return out


def _sorted_list(words: list[str]) -> list[str]:
    if "," not in words:
        return words
    return _join_items(sorted((SEP.join(x) for x in _split(words)), key=_unmarked))


def _unmarked(form: str) -> str:
    return form.replace(_MARK, "")


def _join_items(items: list[str]) -> list[str]:
    out: list[str] = []
    for k, item in enumerate(items):
        if k:
            out.append(",")
        out.append(item)
    return out


def _arrange(words: list[str]) -> list[str]:
    """Sort the free-order lists of one bracket depth."""
    n = len(words)
    if "insert" in words:
        words = _arrange_insert(words)
        n = len(words)
    if "select" not in words and "set" not in words:
        return words
    out: list[str] = []
    i = 0
    while i < n:
        w = words[i]
        out.append(w)
        i += 1
        if w == "select":
            while i < n and words[i] in ("distinct", "all"):
                out.append(words[i])
                i += 1
            if i < n and words[i] == "top":
                out.append(words[i])
                i += 1
                if i < n:
                    out.append(words[i])
                    i += 1
            if i + 1 < n and out[-1] == "distinct" and words[i] == "on" and isinstance(words[i + 1], _Group):
                out += words[i : i + 2]
                i += 2
            j = _list_end(words, i)
            out += _sorted_list(words[i:j])
            i = j
        elif w == "set" and (i == 1 or "update" in words or "insert" in words):
            j = _list_end(words, i, _SET_END)
            out += _sorted_list(words[i:j])
            i = j
    return out


def _list_end(words: list[str], j: int, ends: frozenset[str] = _LIST_END) -> int:
    """Where the list that begins at j ends; the words of a CASE don't end it."""
    depth, begun = 0, j
    while j < len(words):
        w = words[j]
        if not depth and w in ends and not (w in _SOFT_END and (j == begun or words[j - 1] in (",", "."))):
            break
        depth += (w == "case") - (w == "end")
        j += 1
    return j


def _insert_columns(words: list[str], at: int, merges: bool) -> int | None:
    """Where the column list of the INSERT at `at` is: right behind its target, or behind INSERT itself in a MERGE."""
    n, k = len(words), at + 1
    if k < n and isinstance(words[k], _Group):
        return k if merges and words[k + 1 : k + 2] == ["values"] else None
    while k < n and words[k] in _INSERT_WORDS:
        k += 1 + (words[k] == "top")
    k += 1
    while k < n and words[k] == ".":
        k += 1 if words[k + 1 : k + 2] == ["."] else 2
    if words[k : k + 1] in (["as"], ["partition"]):
        k += 2
    return k if k < n and isinstance(words[k], _Group) else None


def _arrange_insert(words: list[str], merges: bool = False) -> list[str]:
    """Sort an INSERT column list, moving each VALUES row or the SELECT list with it; all INSERTs of a MERGE."""
    merges = merges or "merge" in words
    found = (_insert_columns(words, i, merges) for i, w in enumerate(words) if w == "insert")
    k = next((x for x in found if x is not None), None)
    if k is None:
        return words
    columns = words[k].items
    order = sorted(range(len(columns)), key=lambda i: (_unmarked(SEP.join(columns[i])), i))
    rest = words[k + 1 :]
    if "values" in rest and rest[:1] != ["select"]:
        v = end = rest.index("values") + 1
        while end < len(rest) and (isinstance(rest[end], _Group) or rest[end] == ","):
            end += 1
        rows, tail = rest[v:end], rest[end:]
        if merges and "insert" in tail:
            tail = _arrange_insert(tail, True)
        if any(len(r.items) != len(columns) for r in rows if isinstance(r, _Group)):
            return words[: k + 1] + rest[:end] + tail
        moved = [_group([r.items[i] for i in order]) if isinstance(r, _Group) else r for r in rows]
        return words[:k] + [_group([columns[i] for i in order])] + rest[:v] + moved + tail
    if rest[:1] == ["select"]:
        j = _list_end(rest, 1)
        picked = _split(rest[1:j])
        if rest[1:2] in (["distinct"], ["all"], ["top"]) or len(picked) != len(columns):
            return words
        pairs = sorted(zip((SEP.join(c) for c in columns), (SEP.join(p) for p in picked)))
        # Pairs are kept as one list, so the SELECT list isn't sorted apart from its columns.
        return words[:k] + [_group([[c, "=", p] for c, p in pairs]), "pairs"] + rest[j:]
    return words


def _group(items: list[list[str]]) -> _Group:
    g = _Group("(" + SEP + (SEP + "," + SEP).join(SEP.join(x) for x in items) + SEP + ")")
    g.items = items
    return g


def canonical(text: str) -> str:
    """The canonical form; '' for a text of white space, or of white space and semicolons, alone."""
    forms = _forms
    stack: list[list[str]] = []
    words: list[str] = []
    for token in _TOKEN.findall(text):
        if token == "(":
            stack.append(words)
            words = []
        elif token == ")" and stack:
            inner = _split(_arrange(words))
            words = stack.pop()
            words.append(_group(inner))
        else:
            words.append(forms[token])
    while stack:  # never closed: the text is no full statement, but still has a form
        inner = _arrange(words)
        words = stack.pop()
        words.append("(")
        words += inner
    while words and words[-1] == ";":
        words.pop()
    return _unmarked(SEP.join(_arrange(words)))
