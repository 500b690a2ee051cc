"""Rules over statements: one pass for many rules, one row for every finding.

All patterns of a pass are columns of one projection, in generated code: the cheap tests, then the
pattern, then its matches. What didn't match is dropped before a single explode, so that neither the
plan nor the data grows with rules times statements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataql.functions.dialects import canonical_dialect, gate
from strataql.functions.predicates import Pred
from strataql.rules.node_rules import FRAME_RULES, statement_rules
from strataql.rules.spec import SEVERITY_WEIGHT, Rule
from strataql.rules.text_rules import CONDITIONS
from strataql.session import spread


def prepare(statements: DataFrame, text: str = "raw", dialect: str = "dialect") -> DataFrame:
    """Statements with `raw`, its upper case, the canonical dialect and a known query type; null texts are dropped."""
    out = statements.withColumnRenamed(text, "raw") if text != "raw" else statements
    types = F.upper("query_type") if "query_type" in statements.columns else F.lit(None).cast("string")
    return spread(out.filter("raw IS NOT NULL")).withColumns({"raw_upper": F.upper("raw"), "norm_dialect": canonical_dialect(F.col(dialect)), "query_type": types})


def _rule_map(rules: Iterable[Rule], value) -> Column:
    return F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, value(r))])


def with_rule_columns(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """severity, severity_weight and dimension of each finding's rule, from literal maps."""
    if not rules:
        return found.withColumns({"severity": F.lit(None).cast("string"), "severity_weight": F.lit(None).cast("int"), "dimension": F.lit(None).cast("string")})
    return found.withColumns(
        {
            "severity": _rule_map(rules, lambda r: r.severity)[F.col("rule_id")],
            "severity_weight": _rule_map(rules, lambda r: SEVERITY_WEIGHT[r.severity])[F.col("rule_id")],
            "dimension": _rule_map(rules, lambda r: r.dimension)[F.col("rule_id")],
        }
    )


def may_match(rule: Rule, upper: Column) -> Column:
    """The dialect gate, then the words that any match must hold: cheap tests in front of the pattern."""
    may = gate(F.col("norm_dialect"), rule.dialect_list)
    for words in rule.needed:
        held = upper.contains(words[0])
        for word in words[1:]:
            held = held | upper.contains(word)
        may = may & held
    return may


def _quoted(text: str) -> str:
    """A literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hit(rule: Rule) -> str:
    """(rule_id, snippets) where the rule matches, else null; as text, since one parse is faster than thousands of calls."""
    tests = [f"coalesce(norm_dialect IN ({', '.join(map(_quoted, rule.dialect_list))}), FALSE)"] if rule.dialect_list else []
    tests += ["(" + " OR ".join(f"contains(raw_upper, {_quoted(w)})" for w in words) + ")" for words in rule.needed]
    pattern = _quoted(rule.java_pattern)
    tests.append(f"raw RLIKE {pattern}")
    return f"CASE WHEN {' AND '.join(tests)} THEN named_struct('rule_id', {_quoted(rule.rule_id)}, 'snippets', regexp_extract_all(raw, {pattern}, 0)) END"


def pattern_findings(prepared: DataFrame, rules: list[Rule], carry: list[str]) -> DataFrame:
    """One row for every match of every pattern: carried columns, rule_id, ordinal, snippet.

    Patterns ignore letter case, `.` stops at line ends, and matches don't overlap. Rules for some
    dialects run on those only. Without rules or statements the result is empty; repeated statements
    give their findings each.
    """
    if not rules:
        return prepared.select(*carry).limit(0).withColumns({"rule_id": F.lit(""), "ordinal": F.lit(0), "snippet": F.lit("")})
    one = prepared.select(*carry, F.explode(F.expr(f"array_compact(array({', '.join(map(_hit, rules))}))")).alias("hit"))
    return one.select(*carry, F.col("hit.rule_id").alias("rule_id"), F.posexplode("hit.snippets").alias("ordinal", "snippet"))


def firing(prepared: DataFrame, conditions: dict[str, Callable[[Column], Column]], carry: list[str]) -> DataFrame:
    """One row for every statement and condition that holds: carried columns, rule_id.

    A condition is a function from the text's upper case to a Column.
    """
    if not conditions:
        return prepared.select(*carry).limit(0).withColumn("rule_id", F.lit(""))
    names = F.array_compact(F.array(*[F.when(c(F.col("raw_upper")), F.lit(rule_id)) for rule_id, c in conditions.items()]))
    return prepared.select(*carry, F.explode(names).alias("rule_id"))


def text_findings(prepared: DataFrame, rules: list[Rule], carry: list[str], extra: dict[str, Pred] | None = None) -> DataFrame:
    """One row for every statement on which a text condition holds."""
    wanted = {r.rule_id: _gated(r, CONDITIONS[r.rule_id]) for r in rules if r.rule_id in CONDITIONS}
    wanted |= {rule_id: pred.column for rule_id, pred in (extra or {}).items()}
    return firing(prepared, wanted, carry)


def _gated(rule: Rule, pred: Pred) -> Callable[[Column], Column]:
    return lambda upper: gate(F.col("norm_dialect"), rule.dialect_list) & pred.column(upper)


def _held(condition) -> Column:
    """The number of frames that meet a condition; an unknown outcome doesn't."""
    return F.size(F.filter("frames", lambda f: F.coalesce(condition(f), F.lit(False))))


def node_findings(structure: DataFrame, carry: list[str]) -> DataFrame:
    """Findings of all structural rules: carried columns, rule_id, n_findings.

    `structure` comes from structure.structured; its frames are read in place, without a join.
    """
    counts = [F.struct(F.lit(i).alias("rule_id"), _held(c).alias("n_findings")) for i, c in FRAME_RULES.items()]
    counts += [F.struct(F.lit(i).alias("rule_id"), F.coalesce(c, F.lit(False)).cast("int").alias("n_findings")) for i, c in statement_rules().items()]
    hit = F.explode(F.filter(F.array(*counts), lambda x: x["n_findings"] > 0)).alias("hit")
    return structure.select(*carry, hit).select(*carry, "hit.rule_id", "hit.n_findings")
