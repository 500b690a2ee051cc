"""SQL tokens by one alternation, and the summaries by which chunks of a text are lexed apart.

A chunk's summary maps each lexer state the chunk may start in to the state it ends in and to the
brackets it leaves unmatched. Summaries compose associatively, so the pieces of a long text can be
lexed in any grouping and reduced afterwards.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

#: Canonical dialects by the spellings that occur.
DIALECTS = {
    "postgresql": "postgresql",
    "postgres": "postgresql",
    "pg": "postgresql",
    "mysql": "mysql",
    "mariadb": "mysql",
    "tsql": "tsql",
    "t-sql": "tsql",
    "mssql": "tsql",
    "sqlserver": "tsql",
    "oracle": "oracle",
    "sqlite": "sqlite",
    "sqlite3": "sqlite",
    "snowflake": "snowflake",
    "bigquery": "bigquery",
    "bq": "bigquery",
    "redshift": "redshift",
}

BACKSLASH = {"mysql", "bigquery", "snowflake"}
HASH_COMMENT = {"mysql", "bigquery"}
SLASH_COMMENT = {"snowflake"}
DOLLAR_QUOTE = {"postgresql", "redshift", "snowflake"}
BACKTICK = {"mysql", "bigquery", "sqlite"}
BRACKET_NAME = {"tsql", "sqlite"}
NESTED_COMMENT = {"postgresql", "tsql", "redshift"}


def dialect_of(text: str | None) -> str:
    """The canonical dialect of a spelling; '' for none."""
    return DIALECTS.get((text or "").strip().lower(), "")


@lru_cache(maxsize=None)
def pattern(dialect: str) -> re.Pattern:
    """One alternation that cuts a text of the dialect into tokens; white space matches nothing.

    A quote or comment that is never closed runs to the end of the text. Comments don't nest here;
    without_comments takes out those that do.
    """
    single = r"'(?:[^'\\]|\\.|'')*(?:'|\Z)" if dialect in BACKSLASH else r"'(?:[^']|'')*(?:'|\Z)"
    double = r'"(?:[^"\\]|\\.|"")*(?:"|\Z)' if dialect in ("mysql", "bigquery") else r'"(?:[^"]|"")*(?:"|\Z)'
    parts = [r"--[^\r\n]*"]
    if dialect in HASH_COMMENT:
        parts.append(r"\#[^\r\n]*")
    if dialect in SLASH_COMMENT:
        parts.append(r"//[^\r\n]*")
    parts.append(r"/\*.*?(?:\*/|\Z)")
    if dialect == "postgresql" or dialect == "redshift":
        parts.append(r"[eE]'(?:[^'\\]|\\.|'')*(?:'|\Z)")
    if dialect == "oracle":
        parts.append(r"[nN]?[qQ]'(?:\[.*?\]'|\{.*?\}'|\(.*?\)'|<.*?>'|(?P<oq>[^\s\[\{\(<]).*?(?P=oq)')")
    if dialect == "bigquery":
        parts.append(r"[rRbB]{0,2}(?:'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z))")
    parts += [single, double]
    if dialect in DOLLAR_QUOTE:
        parts.append(r"\$(?P<tag>[A-Za-z_]\w*)?\$.*?(?:\$(?(tag)(?P=tag))\$|\Z)")
    parts.append(r"`[^`]*(?:`|\Z)")
    if dialect in BRACKET_NAME:
        parts.append(r"\[[^\]\r\n]*(?:\]|\Z)")
    parts += [
        r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?(?![\w$])|\.\d+(?:[eE][+-]?\d+)?|0[xX][0-9A-Fa-f]+",
        r"[@:$\#]{1,2}[A-Za-z_]\w*|\$\d+" if dialect == "tsql" else r"@{1,2}[A-Za-z_]\w*|\$\d+|:[A-Za-z_]\w*(?<!::)",
        r"\w[\w$]*",
        r"<=>|->>|\#>>|<<=|>>=|<=|>=|<>|!=|\|\||::|:=|=>|->|\#>|<<|>>|\*\*|!~\*|~\*|!~|&&|@>|<@",
        r"\S",
    ]
    return re.compile("|".join(f"(?:{p})" for p in parts), re.DOTALL)


def tokens(text: str, dialect: str = "") -> list[str]:
    """All tokens of a text, comments included."""
    return [m.group() for m in pattern(dialect).finditer(text)]


# ---------------------------------------------------------------------------------------------
# Chunk summaries
#
# States are strings: NORMAL, WORD (within a word, so that what follows is no prefix of a quote), a
# quote mark, ESCAPED (a string with backslashes), a triple quote, BRACKET, LINE, BLOCK and a depth
# ("*1", "*2", ...), DOLLAR and a tag, Q and the character that closes Oracle's q'...'.

NORMAL, WORD, SINGLE, DOUBLE, TICK, ESCAPED, TRIPLE_SINGLE, TRIPLE_DOUBLE, BRACKET, LINE = "n", "w", "'", '"', "`", "e'", "'''", '"""', "[", "-"
BLOCK, DOLLAR, Q = "*", "$", "q"
PAIRS = {")": "(", "]": "[", "}": "{"}
Q_CLOSERS = {"[": "]", "{": "}", "(": ")", "<": ">"}


def states(dialect: str) -> tuple[str, ...]:
    """The states of a dialect that every chunk may begin in; tags, closers and depths come from the chunk."""
    out = [NORMAL, WORD, SINGLE, DOUBLE, TICK, LINE]
    if dialect in BRACKET_NAME:
        out.append(BRACKET)
    if dialect in ("postgresql", "redshift"):
        out.append(ESCAPED)
    if dialect == "bigquery":
        out += [TRIPLE_SINGLE, TRIPLE_DOUBLE]
    if dialect not in NESTED_COMMENT:
        out.append(BLOCK + "1")
    return tuple(out)


@dataclass(frozen=True)
class Effect:
    """What a chunk does from one start state: where it ends, closers it needs, openers it leaves."""

    end: str
    needs: str = ""
    leaves: str = ""
    broken: bool = False


@dataclass(frozen=True)
class Summary:
    """A chunk's effect from each start state.

    Tags and closers that the chunk doesn't hold leave their state as it is. Comments nested deeper
    than the explicit depths stay comments, their depth changed by `net`.
    """

    effects: dict[str, Effect] = field(default_factory=dict)
    deepest: int = 0
    net: int = 0

    def effect(self, state: str) -> Effect:
        found = self.effects.get(state)
        if found is None:
            found = Effect(f"{BLOCK}{int(state[1:]) + self.net}" if state[0] == BLOCK else state)
        return found

    def then(self, after: Summary) -> Summary:
        """This chunk followed by another; associative."""
        starts = dict.fromkeys(self.effects)
        starts |= dict.fromkeys(s for s in after.effects if s[0] in (DOLLAR, Q))
        deepest = max(self.deepest, after.deepest - self.net)
        starts |= dict.fromkeys(f"{BLOCK}{d}" for d in range(self.deepest + 1, deepest + 1))
        return Summary({s: _join(e := self.effect(s), after.effect(e.end)) for s in starts}, deepest, self.net + after.net)

    def to_json(self) -> str:
        return json.dumps([{s: [e.end, e.needs, e.leaves, e.broken] for s, e in self.effects.items()}, self.deepest, self.net])

    @classmethod
    def from_json(cls, text: str) -> Summary:
        effects, deepest, net = json.loads(text)
        return cls({s: Effect(*e) for s, e in effects.items()}, deepest, net)


def _join(a: Effect, b: Effect) -> Effect:
    if not b.needs:
        return Effect(b.end, a.needs, a.leaves + b.leaves, a.broken or b.broken)
    k = min(len(a.leaves), len(b.needs))
    opened = a.leaves[len(a.leaves) - k :][::-1]
    broken = a.broken or b.broken or any(o != PAIRS[c] for o, c in zip(opened, b.needs))
    return Effect(b.end, a.needs + b.needs[k:], a.leaves[: len(a.leaves) - k] + b.leaves, broken)


_WORD_PART = re.compile(r"[\w$]*")
_LINE_END = re.compile(r"[\r\n]")
_QUOTE_OR_ESCAPE = {q: re.compile(rf"{q}|\\.", re.DOTALL) for q in "'\"`"}
_COMMENT_MARK = re.compile(r"/\*|\*/")


@lru_cache(maxsize=None)
def _mark(dialect: str) -> re.Pattern:
    """What changes the state or the brackets outside quotes and comments."""
    parts = []
    if dialect == "bigquery":
        parts += ["'''", '"""']
    if dialect in ("postgresql", "redshift"):
        parts.append(r"(?<![\w$])[eE]'")
    if dialect == "oracle":
        parts.append(r"(?<![\w$])[nN]?[qQ]'\S")
    if dialect in DOLLAR_QUOTE:
        parts.append(r"(?<![\w$])\$(?:[A-Za-z_]\w*)?\$")
    parts += [r"['\"`()\[\]{}]", "--", r"/\*"]
    if dialect in HASH_COMMENT:
        parts.append(r"\#")
    if dialect in SLASH_COMMENT:
        parts.append("//")
    return re.compile("|".join(parts))


def _leave(chunk: str, state: str, i: int, dialect: str) -> tuple[str, int]:
    """Where a quote or comment that is open at i ends: NORMAL and the place behind it, or its state at the end."""
    n = len(chunk)
    if state in (SINGLE, DOUBLE, TICK, ESCAPED):
        quote = state[-1]
        if state == ESCAPED or quote == "'" and dialect in BACKSLASH or quote == '"' and dialect in ("mysql", "bigquery"):
            step = _QUOTE_OR_ESCAPE[quote]
            while (m := step.search(chunk, i)) and m.group() != quote:
                i = m.end()
            return (NORMAL, m.end()) if m else (state, n)
        j = chunk.find(quote, i)
        return (NORMAL, j + 1) if j >= 0 else (state, n)
    if state in (TRIPLE_SINGLE, TRIPLE_DOUBLE):
        j = chunk.find(state, i)
        return (NORMAL, j + 3) if j >= 0 else (state, n)
    if state == WORD:
        j = _WORD_PART.match(chunk, i).end()
        return (NORMAL, j) if j < n else (WORD, n)
    if state == BRACKET:
        j = chunk.find("]", i)
        return (NORMAL, j + 1) if j >= 0 else (state, n)
    if state == LINE:
        m = _LINE_END.search(chunk, i)
        return (NORMAL, m.end()) if m else (state, n)
    if state[0] == DOLLAR or state[0] == Q:
        closer = f"${state[1:]}$" if state[0] == DOLLAR else state[1:] + "'"
        j = chunk.find(closer, i)
        return (NORMAL, j + len(closer)) if j >= 0 else (state, n)
    depth = int(state[1:])
    if dialect not in NESTED_COMMENT:
        j = chunk.find("*/", i)
        return (NORMAL, j + 2) if j >= 0 else (state, n)
    for m in _COMMENT_MARK.finditer(chunk, i):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return NORMAL, m.end()
    return f"{BLOCK}{depth}", n


def _opened(mark: str) -> str:
    """The state that a mark opens."""
    c = mark[0]
    if mark in ("'", '"', "`", "[", TRIPLE_SINGLE, TRIPLE_DOUBLE):
        return mark
    if mark == "/*":
        return BLOCK + "1"
    if c in "-#/":
        return LINE
    if c == "$":
        return DOLLAR + mark[1:-1]
    if c in "eE":
        return ESCAPED
    return Q + Q_CLOSERS.get(mark[-1], mark[-1])


def _effect(chunk: str, state: str, dialect: str) -> Effect:
    """Scan one chunk from one state. Chunks are cut so that no mark of several characters is split."""
    needs, leaves, broken = [], [], False
    i, n = 0, len(chunk)
    step = _mark(dialect)
    while True:
        if state != NORMAL:
            state, i = _leave(chunk, state, i, dialect)
            if state != NORMAL:
                break
        m = step.search(chunk, i)
        if not m:
            if i < n and (chunk[-1].isalnum() or chunk[-1] in "_$"):
                state = WORD
            break
        mark, i = m.group(), m.end()
        c = mark[0]
        if len(mark) == 1 and c in PAIRS:
            if not leaves:
                needs.append(c)
            elif leaves.pop() != PAIRS[c]:
                broken = True
        elif c in "({" or c == "[" and dialect not in BRACKET_NAME:
            leaves.append(c)
        else:
            state = _opened(mark)
    return Effect(state, "".join(needs), "".join(leaves), broken)


def summarize(chunk: str, dialect: str, first: bool = False) -> Summary:
    """The summary of a chunk; the first one of a text may begin in NORMAL only."""
    if first:
        return Summary({NORMAL: _effect(chunk, NORMAL, dialect)})
    starts = list(states(dialect))
    if dialect in DOLLAR_QUOTE:
        ends = [m.start() for m in re.finditer(r"\$", chunk)]
        starts += sorted({DOLLAR + chunk[a + 1 : b] for a, b in zip(ends, ends[1:]) if re.fullmatch(r"(?:[A-Za-z_]\w*)?", chunk[a + 1 : b])})
    if dialect == "oracle":
        starts += sorted({Q + c for c in re.findall(r"(\S)(?=')", chunk)})
    deepest = depth = 0
    if dialect in NESTED_COMMENT:
        for m in _COMMENT_MARK.finditer(chunk):
            depth += 1 if m.group() == "/*" else -1
            deepest = max(deepest, -depth)
        starts += [f"{BLOCK}{d}" for d in range(1, deepest + 1)]
    return Summary({s: _effect(chunk, s, dialect) for s in starts}, deepest, depth)


def chunks(text: str, size: int) -> list[str]:
    """Pieces of about `size` characters, never cut within a mark of several characters, a doubled quote or an escape."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and (text[cut - 1] in "-/*'\"`\\\r$#" or text[cut] in "'\"`$*/-#" or text[cut : cut + 2] in ("q'", "Q'")):
            cut += 1
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def fold(parts: Iterable[Summary]) -> Summary:
    return reduce(Summary.then, parts)


def balanced(summary: Summary) -> bool:
    """Whether a text with this summary, begun normally, ends outside quotes with all brackets matched."""
    e = summary.effect(NORMAL)
    return e.end in (NORMAL, WORD, LINE) and not e.needs and not e.leaves and not e.broken


def without_comments(text: str, dialect: str) -> str:
    """The text with a blank for each block comment, however deep it nests."""
    out, at, i = [], 0, 0
    step = _mark(dialect)
    while m := step.search(text, i):
        mark, i = m.group(), m.end()
        if len(mark) == 1 and mark in "()[]{}" and not (mark == "[" and dialect in BRACKET_NAME):
            continue
        e = _opened(mark)
        _, i = _leave(text, e, i, dialect)
        if e[0] == BLOCK:
            out += [text[at : m.start()], " "]
            at = i
    out.append(text[at:])
    return "".join(out)
