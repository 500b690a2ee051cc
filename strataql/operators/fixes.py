"""Rewrites: safe fixes of rules, fixes by span or text, previews and reports."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First match and replacement of the rules whose rewrite is safe.
SAFE_REWRITES: dict[str, tuple[str, str]] = {
    "PERF-LOCK-002": (r"\s*\bWITH\s*\(\s*(?:NOLOCK|READUNCOMMITTED)\s*\)", ""),
    "QUAL-DUCK-001": (r"\b(INTEGER|VARCHAR|FLOAT|DOUBLE|BOOLEAN|DATE|TIMESTAMP)\s*\(\s*(\w+)\s*\)", "CAST($2 AS $1)"),
    "QUAL-ORA-002": (r"\s*\bFROM\s+DUAL\b", ""),
    "QUAL-MYSQL-001": (r"\bSQL_CALC_FOUND_ROWS\b\s*", ""),
    "QUAL-MYSQL-003": (r"\bLOCK\s+IN\s+SHARE\s+MODE\b", "FOR SHARE"),
    "QUAL-NULL-001": (r"(?:!=|<>)\s*NULL\b", "IS NOT NULL"),
    "QUAL-STYLE-002": (r"\b(EXISTS\s*\(\s*SELECT)\s+\*", "$1 1"),
    "QUAL-TSQL-001": (r"\b(SET\s+ANSI_NULLS)\s+OFF\b", "$1 ON"),
    "QUAL-TSQL-002": (r"\b(SET\s+QUOTED_IDENTIFIER)\s+OFF\b", "$1 ON"),
    "QUAL-MODERN-004": (r"\b(CASE\b(?:(?!\bCASE\b|\bELSE\b|\bEND\b)[\s\S])*?)\bEND\b", "$1ELSE NULL END"),
    "QUAL-PG-001": (r"(\bDO\s+\$\$(?![\s\S]*\bLANGUAGE\b)[\s\S]*\$\$)\s*;?", "$1 LANGUAGE plpgsql;"),
    "QUAL-PG-002": (r"\b(\w+)\s{2,}(->>?|#>>?)\s+", "$1 $2 "),
}


def rewrite(raw: Column, rule_id: str) -> Column:
    """The text with the first match of a rule's safe rewrite replaced."""
    pattern, replacement = SAFE_REWRITES[rule_id]
    out = F.regexp_replace(raw, f"(?is)^(.*?)(?:{pattern})", "$1" + re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", replacement))
    if rule_id == "QUAL-NULL-001":  # = NULL, where neither of the other forms was found
        return F.when(raw.rlike("(?i)" + pattern), out).otherwise(F.regexp_replace(raw, r"(?is)^(.*?)(?<![!<>=])\s*=\s*NULL\b", "$1 IS NULL"))
    return out


def apply(text: str, fixes: list[dict]) -> str:
    """All fixes that can be made: spans from right to left, then texts, longest first, one place each.

    A span must lie within the text, still hold its original and not overlap one already made; a
    text must occur in the original text and still be there.
    """
    out, taken = text, len(text) + 1
    spans = sorted((f for f in fixes if f["start"] is not None and f["end"] is not None), key=lambda f: (f["start"], f["end"]), reverse=True)
    for f in spans:
        a, b = f["start"], f["end"]
        if 0 <= a <= b <= len(text) and b <= taken and (not f["original"] or text[a:b] == f["original"]):
            out = out[:a] + f["replacement"] + out[b:]
            taken = a
    texts = sorted((f for f in fixes if f["start"] is None and f["end"] is None and f["original"]), key=lambda f: (-len(f["original"]), f["rule_id"] or "", f["description"] or ""))
    for f in texts:
        if f["original"] in text:
            out = out.replace(f["original"], f["replacement"] or "", 1)
    return out


def preview(before: str, after: str, name: str = "query") -> str:
    """A unified diff, empty where nothing changes."""
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), f"{name} (before)", f"{name} (after)"))


def _fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fixed = [apply(t, [f.asDict() if hasattr(f, "asDict") else dict(f) for f in fs]) for t, fs in zip(pdf["raw"], pdf["fixes"])]
        yield pd.DataFrame({"key": pdf["key"], "fixed": fixed, "diff": [preview(a, b) for a, b in zip(pdf["raw"], fixed)]})


def apply_fixes(statements: DataFrame, fixes: DataFrame, key: str = "stmt_id") -> DataFrame:
    """key, fixed, diff of every statement that has fixes.

    `fixes` has key, rule_id, description, original, replacement, start, end. A statement's fixes
    meet in one row; repeated fixes count once; null replacements delete.
    """
    columns = ["rule_id", "description", "original", "replacement", "start", "end"]
    cleaned = fixes.withColumn("replacement", F.coalesce("replacement", F.lit("")))
    by_key = cleaned.groupBy(key).agg(F.collect_set(F.struct(*columns)).alias("fixes"))
    joined = statements.filter("raw IS NOT NULL").select(key, "raw").join(by_key, key).select(F.col(key).alias("key"), "raw", "fixes")
    out = joined.mapInPandas(_fix, f"key {statements.schema[key].dataType.simpleString()}, fixed string, diff string")
    return out.withColumnRenamed("key", key)


def fix_report(fixes: DataFrame) -> DataFrame:
    """Fixes by confidence: safe, probable or unsafe, and how many can be made without asking."""
    confidence = F.coalesce(F.lower("confidence"), F.lit("unsafe"))
    return fixes.groupBy(confidence.alias("confidence")).agg(F.count("*").alias("n_fixes"), F.sum(F.coalesce("is_safe", F.lit(False)).cast("long")).alias("n_safe"))
