"""All rules, and the views of them that a registry offers."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.rules import compliance, cost, performance, quality, reliability, schemas, security
from strataql.rules.spec import MEDIUM, PATTERN, SEVERITY_WEIGHT, Rule

MODULES = (security, performance, reliability, compliance, quality, cost, schemas)


def all_rules() -> list[Rule]:
    return [rule for module in MODULES for rule in module.RULES]


def by_id(rule_id: str) -> Rule | None:
    return next((r for r in all_rules() if r.rule_id == rule_id), None)


def family(rule_id: str) -> str:
    """The first two segments of an id, by which rules are allowed or denied together."""
    return "-".join(rule_id.split("-")[:2])


def select(rules: Iterable[Rule], enabled: Iterable[str] = (), disabled: Iterable[str] = ()) -> list[Rule]:
    """Rules on an allow-list of ids or two-segment prefixes (all where it is empty), less the denied ones."""
    allow, deny = set(enabled), set(disabled)
    return [r for r in rules if (not allow or r.rule_id in allow or family(r.rule_id) in allow) and r.rule_id not in deny and family(r.rule_id) not in deny]


def search(text: str) -> list[Rule]:
    low = text.lower()
    return [r for r in all_rules() if low in r.rule_id.lower() or low in r.name.lower() or low in r.category]


def rules_frame(spark: SparkSession, rules: Iterable[Rule] | None = None) -> DataFrame:
    """The catalogue as a table: rule_id, name, severity, severity_weight, dimension, category, dialects, kind, pattern."""
    rows = [(r.rule_id, r.name, r.severity, SEVERITY_WEIGHT[r.severity], r.dimension, r.category, r.dialect_list, r.kind, r.pattern or None) for r in (all_rules() if rules is None else rules)]
    return spark.createDataFrame(rows, "rule_id string, name string, severity string, severity_weight int, dimension string, category string, dialects array<string>, kind string, pattern string")


def stats(frame: DataFrame) -> DataFrame:
    """Rules by dimension, severity and kind, and how many are for some dialects only."""
    return frame.groupBy("dimension", "severity", "kind").agg(F.count("*").alias("n_rules"), F.sum((F.size("dialects") > 0).cast("long")).alias("n_dialect_rules"))


def load_rules(text: str) -> list[Rule]:
    """Custom pattern rules from YAML or JSON: a mapping with `rules`, a list, or one rule.

    Each needs `id` and `pattern`; severity is medium by default, an unknown severity is medium.
    Entries without id or pattern are an error; an empty document has no rules.
    """
    try:
        loaded = json.loads(text)
    except ValueError:
        import yaml  # optional: JSON needs nothing beyond the standard library

        loaded = yaml.safe_load(text)
    if not loaded:
        return []
    entries = loaded.get("rules", [loaded]) if isinstance(loaded, dict) else loaded
    out = []
    for e in entries:
        if not e.get("id") or not e.get("pattern"):
            raise ValueError("a rule needs an id and a pattern")
        severity = str(e.get("severity", MEDIUM)).lower()
        dialects = e.get("dialects") or []
        out.append(CustomRule(e["id"], e.get("name", e["id"]), severity if severity in SEVERITY_WEIGHT else MEDIUM, ",".join(dialects), PATTERN, e["pattern"], str(e.get("dimension", "quality")).lower()))
    return out


class CustomRule(Rule):
    """A rule from outside the catalogue, whose dimension is given, not read from its id."""

    def __init__(self, rule_id: str, name: str, severity: str, dialects: str, kind: str, pattern: str, dimension: str) -> None:
        super().__init__(rule_id, name, severity, dialects, kind, pattern)
        object.__setattr__(self, "_dimension", dimension)

    @property
    def dimension(self) -> str:
        return self._dimension

    @property
    def category(self) -> str:
        return "custom"



