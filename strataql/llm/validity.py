"""Source files that do not parse: statements checked for syntax in their repository's language.

A statement is cut into chunks; each chunk becomes a summary (lexer-state map and unmatched
brackets), the summaries are reduced associatively wherever the chunks lie, and only a balanced
statement is parsed by the local grammars. The shape of a statement (its token classes) decides the parse, so verdicts are
kept by shape within a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataql.llm import grammar
from strataql.llm.lexing import BACKSLASH, BACKTICK, DIALECTS, DOLLAR_QUOTE, NESTED_COMMENT, Summary, balanced, chunks, fold, pattern, summarize, without_comments
from strataql.session import written

#: Characters of one chunk; longer texts are summarised in chunks wherever these land.
CHUNK = 65_536
#: Verdicts and token classes kept in one task.
KEPT = 200_000
#: Neighbouring summaries that the first step makes one.
FAN_IN = 64


_DOLLAR_TAG = re.compile(r"\$(?:[A-Za-z_]\w*)?\$")
_QUOTE = re.compile(r"[A-Za-z]{0,2}('''|\"\"\"|['\"`])")
_CLOSED = {(q, b): re.compile(rf"(?:[^{q}\\]|\\.|{q}{q})*{q}" if b else rf"(?:[^{q}]|{q}{q})*{q}", re.DOTALL) for q in "'\"`" for b in (False, True)}


def _is_closed(token: str, dialect: str) -> bool:
    """Whether a quote or block comment ends with its own mark, not with the text."""
    if token.startswith("/*"):
        return len(token) >= 4 and token.endswith("*/")
    if dialect in DOLLAR_QUOTE and (m := _DOLLAR_TAG.match(token)):
        return len(token) >= 2 * m.end() and token.endswith(m.group())
    m = _QUOTE.match(token)
    if not m:
        return True
    quote = m[1]
    if len(quote) == 3 and dialect == "bigquery":
        return len(token) >= m.end() + 3 and token.endswith(quote)
    if dialect == "oracle" and token[: m.start(1)].lower() in ("q", "nq"):
        return True  # never cut into a token without its end
    quote = quote[0]
    backslash = dialect in BACKSLASH and (quote == "'" or quote == '"' and dialect != "snowflake") or token[0] in "eE"
    return bool(_CLOSED[quote, backslash].fullmatch(token, m.start(1) + 1))


class _Classes(dict):
    """The word of a shape by token, for one dialect; '' for comments, None for what can't be a token."""

    def __init__(self, dialect: str) -> None:
        super().__init__()
        self.dialect = dialect

    def __missing__(self, token: str) -> str | None:
        word = self._class(token)
        if len(self) > KEPT:
            self.clear()
        self[token] = word
        return word

    def _class(self, token: str) -> str | None:
        c, d = token[0], self.dialect
        two = token[:2]
        if two == "--" or two == "/*" or (c == "#" and d in ("mysql", "bigquery")) or (two == "//" and d == "snowflake"):
            return "" if two != "/*" or _is_closed(token, d) else None
        if not _is_closed(token, d):
            return None
        if c == "'" or (len(token) > 2 and "'" in two and c.isalpha()) or two in ('r"', 'b"'):
            return "s"
        if len(token) > 2 and token[1:3] in ("q'", "Q'"):
            return "s"
        if c == '"':
            return "s" if d in ("mysql", "bigquery") else "q"
        if c == "`":
            return "q" if d in BACKTICK else None
        if token in ("#>", "#>>"):
            return token
        if c == ":" and d == "snowflake" and len(token) > 1 and token[1] != ":" and token[1] != "=":
            return "p"
        if c == "[" and len(token) > 1:
            return "q"
        if d in DOLLAR_QUOTE and _DOLLAR_TAG.match(token):
            return "s$"
        if c.isdigit() or (c == "." and len(token) > 1):
            return "n"
        if c.isalpha() or c == "_":
            low = token.lower()
            return low if low in grammar.KEYWORDS else "i"
        if len(token) > 1 and c in "@:$#" and (token[-1].isalnum() or token[-1] == "_"):
            if c == "#" or two == "##":
                return "i"
            if c == "@" and d in ("oracle", "postgresql", "redshift"):
                return None
            return "v"
        return token if c.isascii() and c not in "\\`#{}$" else None


_classes: dict[str, _Classes] = {}
_patterns: dict = {}
_verdicts: dict[tuple[str, str, str], bool] = {}


def _is_valid(text: str, dialect: str) -> bool:
    """Whether a text is a valid script of the dialect; blank and comment-only texts are."""
    if dialect not in _classes:
        _classes[dialect], _patterns[dialect] = _Classes(dialect), pattern(dialect)
    classes = _classes[dialect]
    if dialect in NESTED_COMMENT and text.count("/*") > 1:
        text = without_comments(text, dialect)
    tokens = [m.group() for m in _patterns[dialect].finditer(text)]
    words = [classes[t] for t in tokens]
    if None in words:
        return False
    kept = [w for w in words if w]
    # Where names may be keywords, their spelling is part of the shape.
    spelt = not grammar.HEADS.isdisjoint(kept)
    if not spelt and (dialect == "redshift" or "group" in kept or "for" in kept or kept and kept[0] in ("from", "i")):
        low = text.lower()
        spelt = any(m in low for m in grammar.MARKS[dialect])
    names = [w if w != "i" else t.lower() for t, w in zip(tokens, words) if w] if spelt else None
    key = (dialect, " ".join(kept), " ".join(names) if names else "")
    verdict = _verdicts.get(key)
    if verdict is None:
        if len(_verdicts) > KEPT:
            _verdicts.clear()
        verdict = _verdicts[key] = grammar.valid(kept, dialect, names)
    return verdict


def is_valid(text: str | None, dialect: str, chunk: int = CHUNK) -> bool:
    """Syntactic validity of one statement; null, blank and comment-only texts are valid."""
    if text is None:
        return True
    parts = chunks(text, chunk)
    return balanced(fold(summarize(p, dialect, k == 0) for k, p in enumerate(parts))) and _is_valid(text, dialect)


def _check(chunk: int):
    """Texts of one chunk: its summary is the whole text's. Longer ones go on with their text and no verdict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            far = [t is not None and len(t) > chunk for t in pdf["text"]]
            bad = [None if f else t is not None and not (balanced(summarize(t, d, True)) and _is_valid(t, d)) for t, d, f in zip(pdf["text"], pdf["dialect"], far)]
            yield pd.DataFrame({"repo": pdf["repo"], "file": pdf["file"], "dialect": pdf["dialect"], "bad": bad, "text": [t if f else None for t, f in zip(pdf["text"], far)]})

    return run


def _cut(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sha, dialect, text in zip(pdf["sha"], pdf["dialect"], pdf["text"]):
                parts = chunks(text, chunk)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pd.DataFrame({"sha": sha, "dialect": dialect, "seq": range(at, at + len(some)), "part": some})

    return run


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [summarize(p, d, k == 0).to_json() for p, d, k in zip(pdf["part"], pdf["dialect"], pdf["seq"])]
        yield pd.DataFrame({"sha": pdf["sha"], "dialect": pdf["dialect"], "seq": pdf["seq"], "summary": made})


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring summaries of one text made one."""
    ordered = pdf.sort_values("seq")
    one = fold(map(Summary.from_json, ordered["summary"]))
    return pd.DataFrame({"sha": ordered["sha"][:1], "dialect": ordered["dialect"][:1], "seq": ordered["seq"][:1] // FAN_IN, "summary": one.to_json(), "balanced": balanced(one)})


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bad = [not _is_valid(t, d) for t, d in zip(pdf["text"], pdf["dialect"])]
        yield pd.DataFrame({"sha": pdf["sha"], "dialect": pdf["dialect"], "bad": bad})


def _long_validity(long: DataFrame, chunk: int) -> DataFrame:
    """sha, dialect, bad of texts of several chunks, each text once however often it occurs.

    Chunks are rows that may lie anywhere; their summaries meet by text in two steps, neighbours
    first. Only texts that come out balanced are parsed.
    """
    texts = long.select("sha", "dialect", "text").dropDuplicates(["sha", "dialect"])
    parts = texts.mapInPandas(_cut(chunk), "sha string, dialect string, seq int, part string")
    made = parts.repartition("sha", "seq").mapInPandas(_summaries, "sha string, dialect string, seq int, summary string")
    kind = "sha string, dialect string, seq int, summary string, balanced boolean"
    near = made.groupBy("sha", "dialect", F.floor(F.col("seq") / FAN_IN)).applyInPandas(_reduce, kind).drop("balanced")
    whole = near.groupBy("sha", "dialect").applyInPandas(_reduce, kind)
    decided = texts.join(whole.select("sha", "dialect", "balanced"), ["sha", "dialect"])
    parsed = decided.filter("balanced").select("sha", "dialect", "text").mapInPandas(_parse, "sha string, dialect string, bad boolean")
    return parsed.unionByName(whole.filter("NOT balanced").select("sha", "dialect", F.lit(True).alias("bad")))


def file_validity(statements: DataFrame, repositories: DataFrame, repo: str = "repo_id", file: str = "file", text: str = "raw", dialect: str = "dialect", chunk: int = CHUNK) -> DataFrame:
    """repo, file, dialect, n_statements, n_bad for every file.

    `repositories` names the language of each repository (fixed table, one row a repository). Texts
    that are null, blank or comments only are valid; a repository without a known language gets
    dialect '' whose grammar has only what all share; a null file or repository is a group of its
    own; repeated rows count each; an empty table gives an empty result; further columns are
    ignored. Texts are taken whole, in chunks of CHUNK characters.
    """
    spelt = repositories.select(F.col(repo).alias("repo"), F.lower(F.trim(dialect)).alias("spelt"))
    rows = statements.select(F.col(repo).alias("repo"), F.col(file).alias("file"), F.col(text).alias("text")).join(spelt, "repo", "left")
    names = F.create_map(*[F.lit(x) for pair in DIALECTS.items() for x in pair])
    rows = rows.select("repo", "file", "text", F.coalesce(names[F.col("spelt")], F.lit("")).alias("dialect"))
    checked = written(rows.mapInPandas(_check(chunk), "repo long, file string, dialect string, bad boolean, text string"), "checked", long=F.count("text"))
    if checked.counts["long"]:
        long = checked.filter("text IS NOT NULL").select("repo", "file", "dialect", "text", F.sha2("text", 256).alias("sha"))
        met = long.join(_long_validity(long, chunk), ["sha", "dialect"]).select("repo", "file", "dialect", "bad")
        checked = checked.filter("text IS NULL").drop("text").unionByName(met)
    return checked.groupBy("repo", "file", "dialect").agg(F.count("*").alias("n_statements"), F.sum(F.col("bad").cast("long")).alias("n_bad"))


def rates(files: DataFrame) -> DataFrame:
    """Files, bad files and their rate by repository and language, from file_validity's rows."""
    return (
        files.groupBy("repo", "dialect")
        .agg(F.count("*").alias("n_files"), F.sum((F.col("n_bad") > 0).cast("long")).alias("n_bad_files"))
        .withColumn("bad_rate", F.round(F.col("n_bad_files") / F.col("n_files"), 6))
    )
