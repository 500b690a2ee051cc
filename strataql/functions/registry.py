"""Own rules and functions: rules written in Python, and the library's functions for SQL."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from strataql.operators.findings import pattern_findings
from strataql.operators.splitting import split, without_templates
from strataql.rules.catalog import all_rules, load_rules
from strataql.rules.spec import PATTERN, Rule

#: Own rules by id: a Column condition over prepared statements, or a function from text to snippets.
ColumnRule = Callable[[], Column]
TextRule = Callable[[str], list[str]]


class RuleRegistry:
    """Rules by id; the first of an id stays."""

    def __init__(self) -> None:
        self.patterns: dict[str, Rule] = {}
        self.columns: dict[str, ColumnRule] = {}
        self.texts: dict[str, TextRule] = {}

    def __contains__(self, rule_id: str) -> bool:
        return rule_id in self.patterns or rule_id in self.columns or rule_id in self.texts

    def add(self, rule_id: str, rule: Rule | ColumnRule | TextRule, as_text: bool = False) -> bool:
        """Add a rule unless its id is taken; whether it was added."""
        if rule_id in self:
            return False
        target = self.patterns if isinstance(rule, Rule) else self.texts if as_text else self.columns
        target[rule_id] = rule
        return True

    def load(self, path: str) -> int:
        """Rules of a YAML or JSON file, or of a Python file that has `RULES` (id to Column function); how many were added."""
        p = Path(path)
        if p.is_dir():
            return sum(self.load(str(x)) for x in sorted(p.iterdir()) if x.suffix in (".py", ".yml", ".yaml", ".json") and not x.name.startswith("_"))
        if p.suffix != ".py":
            return sum(self.add(r.rule_id, r) for r in load_rules(p.read_text()))
        spec = importlib.util.spec_from_file_location(f"strataql_rules_{p.stem}", p)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return sum(self.add(i, r) for i, r in getattr(module, "RULES", {}).items())

    def findings(self, prepared: DataFrame, key: str) -> DataFrame:
        """key, rule_id, snippet of pattern rules, Column rules and text rules over prepared statements."""
        out = None
        if self.patterns:
            out = pattern_findings(prepared, list(self.patterns.values()), [key]).select(key, "rule_id", "snippet")
        if self.columns:
            named = [F.when(F.coalesce(c(), F.lit(False)), F.lit(i)) for i, c in self.columns.items()]
            found = prepared.select(key, F.explode(F.array_compact(F.array(*named))).alias("rule_id"), F.col("raw").alias("snippet"))
            out = found if out is None else out.unionByName(found)
        if self.texts:
            rules = dict(self.texts)

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    rows = [(k, i, s) for k, t in zip(pdf["key"], pdf["raw"]) for i, r in rules.items() for s in r(t)]
                    yield pd.DataFrame(rows, columns=["key", "rule_id", "snippet"])

            found = prepared.select(F.col(key).alias("key"), "raw").mapInPandas(run, f"key {prepared.schema[key].dataType.simpleString()}, rule_id string, snippet string").withColumnRenamed("key", key)
            out = found if out is None else out.unionByName(found)
        return prepared.select(key, F.lit("").alias("rule_id"), F.col("raw").alias("snippet")).limit(0) if out is None else out


@dataclass(frozen=True)
class Analyzer:
    """A named part of an analysis: prepared statements and the columns to carry, to findings with rule_id."""

    name: str
    dimension: str
    run: Callable[[DataFrame, list[str]], DataFrame]
    priority: int = 100
    enabled: bool = True


class AnalyzerRegistry:
    """Analyzers by name, run in order of priority, then name."""

    def __init__(self) -> None:
        self._by_name: dict[str, Analyzer] = {}

    def __len__(self) -> int:
        return len(self._by_name)

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def register(self, analyzer: Analyzer, override: bool = False) -> None:
        """Add an analyzer; a name that is taken is an error unless it is to be replaced."""
        if analyzer.name in self and not override:
            raise ValueError(f"{analyzer.name} is registered already")
        self._by_name[analyzer.name] = analyzer

    def unregister(self, name: str) -> Analyzer | None:
        return self._by_name.pop(name, None)

    def get(self, name: str) -> Analyzer | None:
        return self._by_name.get(name)

    def all(self, dimension: str | None = None, enabled_only: bool = False) -> list[Analyzer]:
        chosen = (a for a in self._by_name.values() if dimension in (None, a.dimension) and (a.enabled or not enabled_only))
        return sorted(chosen, key=lambda a: (a.priority, a.name))

    def findings(self, prepared: DataFrame, carry: list[str]) -> DataFrame | None:
        """Carried columns, rule_id, analyzer of all enabled analyzers' findings; None without any."""
        out = None
        for a in self.all(enabled_only=True):
            one = a.run(prepared, carry).select(*carry, "rule_id", F.lit(a.name).alias("analyzer"))
            out = one if out is None else out.unionByName(one)
        return out

    def stats(self) -> dict[str, int]:
        return {"analyzers": len(self), "enabled": len(self.all(enabled_only=True)), "dimensions": len({a.dimension for a in self._by_name.values()})}


def builtin_analyzers() -> AnalyzerRegistry:
    """One analyzer a dimension, over the catalogue's patterns of it."""
    found = AnalyzerRegistry()
    for at, dimension in enumerate(("security", "performance", "reliability", "compliance", "quality", "cost")):
        rules = [r for r in all_rules() if r.kind == PATTERN and r.dimension == dimension]
        found.register(Analyzer(dimension, dimension, lambda df, carry, rules=rules: pattern_findings(df, rules, carry), 10 * (at + 1)))
    return found


class _SplitSql:
    """Table function: the statements of a script."""

    def eval(self, text: str):
        if text:
            for k, (_, start, end, line, column) in enumerate(split(without_templates(text))):
                yield k, text[start:end], start, end, line, column


def _strip(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else without_templates(t))


def register(spark: SparkSession) -> None:
    """split_sql(text) as a table function and strip_templates(text), for SQL."""
    spark.udtf.register("split_sql", udtf(_SplitSql, returnType="query_index int, raw string, start_offset int, end_offset int, line_no int, col_no int"))
    spark.udf.register("strip_templates", pandas_udf(_strip, "string"))
