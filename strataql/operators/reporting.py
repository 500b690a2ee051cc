"""Aggregates over findings: statistics, scores, pivots, trends, comparisons and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataql.operators.relational import difference_in_order, numbered
from strataql.rules.spec import SEVERITY_WEIGHT

SEVERITIES = tuple(SEVERITY_WEIGHT)
# What a finding takes from the health score, and adds to a statement's complexity.
HEALTH_COST = {"critical": 25, "high": 15, "medium": 5, "low": 2, "info": 0}
COMPLEXITY_COST = {"critical": 25, "high": 15, "medium": 10, "low": 5, "info": 2}


def _by_severity(severity: Column, values: dict[str, int], default: int = 0) -> Column:
    out = None
    for s, v in values.items():
        out = F.when(severity == s, v) if out is None else out.when(severity == s, v)
    return out.otherwise(default)


def by_severity_sql(severity: str, values: dict[str, int], default: int = 0) -> str:
    return f"CASE {severity} " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in values.items()) + f" ELSE {default} END"


def weight(severity: Column) -> Column:
    return _by_severity(severity, SEVERITY_WEIGHT)


def zero_filled(findings: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of findings by a column for each of the given values, 0 where there are none."""
    dim = findings.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counted = findings.groupBy(column).agg(F.count("*").alias("n"))
    return dim.join(F.broadcast(counted.filter(F.col(column).isin(*values))), column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n_findings"))


def health(findings: DataFrame, by: list[str]) -> DataFrame:
    """100 less what the findings cost, at least 0."""
    cost = F.sum(_by_severity(F.col("severity"), HEALTH_COST))
    return findings.groupBy(*by).agg(F.greatest(F.lit(0), 100 - F.least(cost, F.lit(100))).cast("int").alias("health"))


def heat_map(findings: DataFrame) -> DataFrame:
    """Findings by dimension across severities; info is left out."""
    shown = [s for s in SEVERITIES if s != "info"]
    return findings.filter(F.col("severity").isin(*shown)).groupBy("dimension").pivot("severity", shown).count().na.fill(0)


def spectrum(findings: DataFrame) -> DataFrame:
    """Each rule's findings and its share of all, in percent."""
    counted = findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"))
    total = F.sum("n_findings").over(Window.partitionBy())  # one row a rule
    return counted.withColumn("share", F.round(F.col("n_findings") * 100.0 / total, 4))


def exit_codes(findings: DataFrame, threshold: str = "high") -> DataFrame:
    """result_code: 3 for critical, 2 for high, 1 for medium or low, else 0; fail_code: 2 from the threshold on."""
    top = F.coalesce(F.max(weight(F.col("severity"))), F.lit(0))
    return findings.agg(top.alias("w")).select(
        F.when(F.col("w") >= 5, 3).when(F.col("w") == 4, 2).when(F.col("w") >= 2, 1).otherwise(0).alias("result_code"),
        F.when(F.col("w") >= SEVERITY_WEIGHT[threshold], 2).otherwise(0).alias("fail_code"),
    )


def structural_score(raw: Column) -> Column:
    """10, plus 10 a join, 15 a subquery, 5 an aggregate call, from the text alone."""
    joins = F.regexp_count(raw, F.lit(r"(?i)\bJOIN\b"))
    selects = F.regexp_count(raw, F.lit(r"(?i)\bSELECT\b"))
    aggregates = F.regexp_count(raw, F.lit(r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\("))
    return 10 + 10 * joins + 15 * F.greatest(selects - 1, F.lit(0)) + 5 * aggregates


def complexity(statements: DataFrame, findings: DataFrame, key: str = "stmt_id") -> DataFrame:
    """key, score (0 to 100) of every statement: structure plus its findings; null texts score their findings."""
    extra = findings.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(_by_severity(F.col("severity"), COMPLEXITY_COST)).alias("extra"))
    score = F.coalesce(structural_score(F.col("raw")), F.lit(0)) + F.coalesce("extra", F.lit(0))
    return statements.select(key, "raw").join(extra, key, "left").select(key, F.least(F.greatest(score, F.lit(0)), F.lit(100)).cast("int").alias("score"))


def band(score: Column) -> Column:
    return F.when(score < 40, "OPTIMAL").when(score < 70, "COMPLEX").otherwise("CRITICAL")


def trend(scored: DataFrame, key: str, at: str, ties: list[str]) -> DataFrame:
    """Each score less the one before of the same statement text, by time; null for the first."""
    return difference_in_order(scored, [key], at, ties, "score", "trend")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings before and after, the difference, and it in percent of before."""
    one = before.agg(F.count("*").alias("n_before")).withColumn("k", F.lit(1))
    two = after.agg(F.count("*").alias("n_after")).withColumn("k", F.lit(1))
    delta = F.col("n_after") - F.col("n_before")
    return one.join(F.broadcast(two), "k").select("n_before", "n_after", delta.alias("delta"), F.when(F.col("n_before") > 0, F.round(delta * 100.0 / F.col("n_before"), 4)).alias("percent"))


def annotation(severity: Column, file: Column, line: Column, column: Column, rule_id: Column, message: Column) -> Column:
    """A workflow annotation line: ::level file=,line=,col=::id message, with its escapes."""

    def data(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def prop(c: Column) -> Column:
        return F.replace(F.replace(data(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))

    level = F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("notice")
    place = F.concat_ws(",", F.when(file.isNotNull(), F.concat(F.lit("file="), prop(file))), F.concat(F.lit("line="), line.cast("string")), F.concat(F.lit("col="), column.cast("string")))
    return F.concat(F.lit("::"), level, F.lit(" "), place, F.lit("::"), rule_id, F.lit(" "), data(F.coalesce(message, F.lit(""))))


def csv_line(*columns: Column) -> Column:
    """Comma-separated fields, quoted where they hold a comma, quote or line end; null is empty."""

    def quoted(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[quoted(c) for c in columns])


def html_row(*columns: Column) -> Column:
    """An escaped table row."""

    def escaped(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    return F.concat(F.lit("<tr>"), *[escaped(c) for c in columns], F.lit("</tr>"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 reportingDescriptor for each rule, by its first finding."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("message", level.alias("level")), "issue_id").alias("f"))
    return first.select("rule_id", F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("f.message").alias("text")).alias("shortDescription"), F.struct(F.col("f.level").alias("level")).alias("defaultConfiguration"))).alias("rule"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result for each finding."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    region = F.struct(F.greatest(F.coalesce("line_no", F.lit(1)), F.lit(1)).alias("startLine"), F.greatest(F.coalesce("col_no", F.lit(1)), F.lit(1)).alias("startColumn"))
    place = F.array(F.struct(F.struct(F.struct(F.coalesce("file", F.lit("<stdin>")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return findings.select("issue_id", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), place.alias("locations"))).alias("result"))


# The version of the log format and its schema.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def sarif_log(findings: DataFrame, tool: str, version: str = "1") -> DataFrame:
    """A whole SARIF log as lines (`value`), in order: the head with tool and rules, one line a result, the tail.

    The rules, at most one a rule of the catalogue, are gathered into the head; results stay rows.
    Findings need rule_id, message, severity, dimension, file, line_no and col_no.
    """
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    rule = F.struct(
        F.col("rule_id").alias("id"), F.regexp_replace("rule_id", "-", "").alias("name"), F.struct(F.col("text")).alias("shortDescription"), F.struct(F.col("dimension").alias("category")).alias("properties")
    )
    first = findings.groupBy("rule_id", "dimension").agg(F.min("message").alias("text"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.array_sort(F.collect_list(rule)).alias("rules"))
    opening = F.concat(F.lit(f'{{"version": "{SARIF_VERSION}", "$schema": "{SARIF_SCHEMA}", "runs": [{{"tool": {{"driver": '), F.to_json(driver), F.lit('}, "results": ['))
    head = first.agg(opening.alias("value")).select(F.lit(0).cast("long").alias("n"), "value")
    region = F.struct(F.greatest(F.coalesce("line_no", F.lit(1)), F.lit(1)).alias("startLine"), F.greatest(F.coalesce("col_no", F.lit(1)), F.lit(1)).alias("startColumn"))
    place = F.array(F.struct(F.struct(F.struct(F.coalesce("file", F.lit("unknown")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), level.alias("level"), place.alias("locations"))
    lines = numbered(findings.select("file", "line_no", "rule_id", F.to_json(result).alias("value")), ["file", "line_no", "rule_id", "value"], "n")
    results = lines.select("n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), F.col("value")).alias("value"))
    tail = head.select(F.lit(2**62).alias("n"), F.lit("]}]}").alias("value"))
    return head.unionByName(results).unionByName(tail).orderBy("n").select("value")
