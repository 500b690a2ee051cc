"""Conditions over a statement's text that read the same as a Spark Column and as SQL for another engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Pred:
    """A condition over `raw`, its upper case, which the caller tells once, and `query_type`."""

    def column(self, upper: Column) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def __and__(self, other: Pred) -> Pred:
        return _Both(self, other)

    def __or__(self, other: Pred) -> Pred:
        return _Either(self, other)

    def __invert__(self) -> Pred:
        return _Not(self)


@dataclass(frozen=True)
class _Both(Pred):
    a: Pred
    b: Pred

    def column(self, upper: Column) -> Column:
        return self.a.column(upper) & self.b.column(upper)

    def sql(self) -> str:
        return f"({self.a.sql()} AND {self.b.sql()})"


@dataclass(frozen=True)
class _Either(Pred):
    a: Pred
    b: Pred

    def column(self, upper: Column) -> Column:
        return self.a.column(upper) | self.b.column(upper)

    def sql(self) -> str:
        return f"({self.a.sql()} OR {self.b.sql()})"


@dataclass(frozen=True)
class _Not(Pred):
    a: Pred

    def column(self, upper: Column) -> Column:
        return ~self.a.column(upper)

    def sql(self) -> str:
        return f"(NOT {self.a.sql()})"


@dataclass(frozen=True)
class has(Pred):
    """The text holds any of these words, in any letter case."""

    words: tuple[str, ...]

    def __init__(self, *words: str) -> None:
        object.__setattr__(self, "words", words)

    def column(self, upper: Column) -> Column:
        out = upper.contains(self.words[0])
        for w in self.words[1:]:
            out = out | upper.contains(w)
        return out

    def sql(self) -> str:
        return "(" + " OR ".join(f"contains(upper(raw), {sql_text(w)})" for w in self.words) + ")"


@dataclass(frozen=True)
class matches(Pred):
    """A pattern, without case, is found in the text."""

    pattern: str

    def column(self, upper: Column) -> Column:
        return F.col("raw").rlike("(?i)" + self.pattern)

    def sql(self) -> str:
        return f"regexp_matches(raw, {sql_text(self.pattern)}, 'i')"


@dataclass(frozen=True)
class counted(Pred):
    """Patterns, with their letter case as given, are found at least n times in all."""

    n: int
    patterns: tuple[str, ...]

    def __init__(self, n: int, *patterns: str) -> None:
        object.__setattr__(self, "n", n)
        object.__setattr__(self, "patterns", patterns)

    def column(self, upper: Column) -> Column:
        out = F.regexp_count("raw", F.lit(self.patterns[0]))
        for p in self.patterns[1:]:
            out = out + F.regexp_count("raw", F.lit(p))
        return out >= self.n

    def sql(self) -> str:
        return "(" + " + ".join(f"len(regexp_extract_all(raw, {sql_text(p)}))" for p in self.patterns) + f" >= {self.n})"


@dataclass(frozen=True)
class typed(Pred):
    """The statement's type is one of these; `or_unknown` lets a missing type pass."""

    types: tuple[str, ...]
    or_unknown: bool = True

    def column(self, upper: Column) -> Column:
        return F.coalesce(F.upper("query_type").isin(*self.types), F.lit(self.or_unknown))

    def sql(self) -> str:
        return f"coalesce(upper(query_type) IN ({', '.join(map(sql_text, self.types))}), {self.or_unknown})"
