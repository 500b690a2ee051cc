"""Quality rules."""

from __future__ import annotations

from strataql.rules.spec import CRITICAL, HIGH, INFO, LOW, MEDIUM, NODE, PATTERN, TEXT, Rule

# Ids, names, severities, dialects (none: all) and patterns of the catalogue.
# fmt: off
RULES = [
    Rule("QUAL-COMPLEX-001", "Excessive CASE Nesting", MEDIUM, "", NODE),
    Rule("QUAL-COMPLEX-002", "Excessive Subquery Nesting", MEDIUM, "", NODE),
    Rule("QUAL-COMPLEX-003", "God Query", MEDIUM, "", NODE),
    Rule("QUAL-COMPLEX-004", "Cyclomatic Complexity in Stored Procedure", LOW, "", PATTERN, r"""\b(CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE|CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION)\b[\s\S]*?(?:(?:\bIF\b|\bWHILE\b|\bCASE\b)[\s\S]*?){5,}"""),
    Rule("QUAL-COMPLEX-005", "Long Query (Line Count)", INFO, "", TEXT),
    Rule("QUAL-DBT-001", "Missing dbt Ref", MEDIUM, "", TEXT),
    Rule("QUAL-DBT-002", "Hardcoded Schema", MEDIUM, "", TEXT),
    Rule("QUAL-DEAD-001", "Unused Database Object", MEDIUM, "", TEXT),
    Rule("QUAL-DEAD-003", "Duplicate Query", LOW, "", TEXT),
    Rule("QUAL-DEAD-002", "Unreachable Code", MEDIUM, "", NODE),
    Rule("QUAL-DOC-001", "Missing Column Comments", INFO, "", PATTERN, r"""CREATE\s+TABLE\s+(?:(?!COMMENT).)*?(?:\);|\Z)"""),
    Rule("QUAL-DOC-002", "Magic Constant Without Comment", LOW, "", PATTERN, r"""(?<!--)WHERE\s+.*\s*=\s*[\'"].+[\'"](?!\s*--)"""),
    Rule("QUAL-DOC-003", "Complex Logic Without Explanation", INFO, "", TEXT),
    Rule("QUAL-DRY-001", "Duplicate WHERE Condition", MEDIUM, "", PATTERN, r"""\bWHERE\b.+\b(\w+)\s*=\s*('[^']*'|\d+)\s+AND\s+\1\s*=\s*\2"""),
    Rule("QUAL-DUCK-001", "Deprecated Old-Style Type Cast", LOW, "duckdb", PATTERN, r"""\b(?:INTEGER|VARCHAR|FLOAT|DOUBLE|BOOLEAN|DATE|TIMESTAMP)\s*\(\s*\w+\s*\)"""),
    Rule("QUAL-PG-002", "JSONB Operator Spacing", LOW, "postgresql", PATTERN, r"""\b(\w+)\s{2,}(->>?|#>>?)\s+"""),
    Rule("QUAL-ORA-001", "ROWNUM Without ORDER BY", HIGH, "oracle", PATTERN, r"""\bROWNUM\b(?![\s\S]*\bORDER\s+BY\b)"""),
    Rule("QUAL-ORA-002", "SELECT FROM DUAL in Application SQL", INFO, "oracle", PATTERN, r"""\bFROM\s+DUAL\b"""),
    Rule("QUAL-MODERN-001", "Implicit Join Syntax", LOW, "", NODE),
    Rule("QUAL-MODERN-002", "Hardcoded Date Literal in Filter", LOW, "", PATTERN, r"""\bWHERE\b.+['\"](\d{4}-\d{2}-\d{2})['\"]"""),
    Rule("QUAL-MODERN-003", "UNION Without ALL — Implicit Deduplication", LOW, "", PATTERN, r"""\bUNION\b(?!\s+ALL\b)"""),
    Rule("QUAL-MYSQL-001", "Deprecated SQL_CALC_FOUND_ROWS", LOW, "mysql", PATTERN, r"""\bSQL_CALC_FOUND_ROWS\b"""),
    Rule("QUAL-ORA-003", "NVL in WHERE Clause", LOW, "oracle", PATTERN, r"""\bWHERE\b.*\bNVL\s*\("""),
    Rule("PERF-MYSQL-004", "GROUP BY Implicit Sort (Removed in MySQL 8.0)", LOW, "mysql", PATTERN, r"""\bGROUP\s+BY\b(?![\s\S]*\bORDER\s+BY\b)"""),
    Rule("QUAL-MYSQL-003", "Deprecated LOCK IN SHARE MODE", LOW, "mysql", PATTERN, r"""\bLOCK\s+IN\s+SHARE\s+MODE\b"""),
    Rule("QUAL-NAME-001", "Inconsistent Table Naming", LOW, "", NODE),
    Rule("QUAL-NAME-002", "Ambiguous Alias", LOW, "", NODE),
    Rule("QUAL-NAME-003", "Hungarian Notation in Names", LOW, "", PATTERN, r"""\b(str_|int_|i_|tbl_|v_|idx_|fk_|pk_)[a-z0-9_]+\b"""),
    Rule("QUAL-NAME-004", "Reserved Word as Identifier", MEDIUM, "", NODE),
    Rule("QUAL-NULL-001", "Incorrect NULL Comparison", HIGH, "", PATTERN, r"""(?<![A-Z_])\s*=\s*NULL\b|\bNULL\s*=\s*(?![A-Z_])|!=\s*NULL\b|<>\s*NULL\b"""),
    Rule("QUAL-MODERN-004", "CASE Without ELSE", LOW, "", NODE),
    Rule("QUAL-SCHEMA-001", "Missing Primary Key", HIGH, "", PATTERN, r"""CREATE\s+TABLE\s+(?:(?!PRIMARY\s+KEY).)*?(?:\);|\Z)"""),
    Rule("QUAL-SCHEMA-002", "Implicit Foreign Key (Logic)", MEDIUM, "", NODE),
    Rule("QUAL-SCHEMA-003", "Missing Index on Foreign Key", MEDIUM, "", NODE),
    Rule("QUAL-SCHEMA-004", "Float for Currency", HIGH, "", PATTERN, r"""\b(price|amount|balance|cost|total|sum)\b.*?\b(FLOAT|REAL|DOUBLE)\b"""),
    Rule("QUAL-STYLE-001", "SELECT Without FROM Clause", INFO, "", PATTERN, r"""^\s*SELECT\b(?![\s\S]*\bFROM\b)[\s\S]+$"""),
    Rule("QUAL-STYLE-002", "Wildcard in EXISTS Subquery", INFO, "", PATTERN, r"""\bEXISTS\s*\(\s*SELECT\s+\*"""),
    Rule("QUAL-STYLE-003", "Subquery Missing Alias", HIGH, "", PATTERN, r"""\bFROM\s*\(\s*SELECT\b[^)]+\)\s*WHERE\b"""),
    Rule("QUAL-STYLE-004", "Commented-Out SQL Code", INFO, "", PATTERN, r"""--\s*(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE)\b|/\*.*?(SELECT|INSERT|UPDATE|DELETE)\b.*?\*/"""),
    Rule("QUAL-MYSQL-002", "STRAIGHT_JOIN Hint", LOW, "mysql", PATTERN, r"""\bSTRAIGHT_JOIN\b"""),
    Rule("QUAL-TSQL-001", "SET ANSI_NULLS OFF", MEDIUM, "tsql", PATTERN, r"""\bSET\s+ANSI_NULLS\s+OFF\b"""),
    Rule("QUAL-PG-001", "DO Block Without LANGUAGE", LOW, "postgresql", PATTERN, r"""\bDO\s+\$\$(?!.*\bLANGUAGE\b)"""),
    Rule("QUAL-RS-001", "DISTSTYLE ALL on Large Table", MEDIUM, "redshift", PATTERN, r"""\bDISTSTYLE\s+ALL\b"""),
    Rule("QUAL-CH-001", "ORDER BY Without LIMIT on ClickHouse", MEDIUM, "clickhouse", TEXT),
    Rule("QUAL-SF-001", "FLATTEN Without Explicit Path", LOW, "snowflake", PATTERN, r"""\bFLATTEN\s*\(\s*(?!.*\binput\b|.*\bpath\b)"""),
    Rule("QUAL-STYLE-005", "INSERT Without Column List", MEDIUM, "", NODE),
    Rule("QUAL-TSQL-002", "SET QUOTED_IDENTIFIER OFF", MEDIUM, "tsql", PATTERN, r"""\bSET\s+QUOTED_IDENTIFIER\s+OFF\b"""),
    Rule("QUAL-DEBT-001", "Technical Debt Marker", INFO, "", PATTERN, r"""\b(TODO|FIXME|XXX|HACK)\b"""),
    Rule("QUAL-DEBT-002", "Permanent Temporary Table", LOW, "", PATTERN, r"""CREATE\s+(?:TEMPORARY|TEMP)\s+TABLE\s+(\w+)(?:(?!DROP\s+TABLE\s+\1).)*\Z"""),
    Rule("QUAL-TEST-001", "Non-Deterministic Query", LOW, "", NODE),
    Rule("QUAL-TEST-002", "Pagination Without ORDER BY", MEDIUM, "", NODE),
    Rule("QUAL-TEST-003", "Hardcoded Test Data", LOW, "", PATTERN, r"""[\'"][^\'"]*(test|dummy|fake|temp|asdf|qwerty)[^\'"]*[\'"]"""),
]
# fmt: on
