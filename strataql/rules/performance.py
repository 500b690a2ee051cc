"""Performance rules."""

from __future__ import annotations

from strataql.rules.spec import CRITICAL, HIGH, INFO, LOW, MEDIUM, NODE, PATTERN, TEXT, Rule

# Ids, names, severities, dialects (none: all) and patterns of the catalogue.
# fmt: off
RULES = [
    Rule("PERF-AGG-001", "Unfiltered Aggregation", MEDIUM, "", NODE),
    Rule("PERF-AGG-002", "ORDER BY in Subquery", LOW, "", PATTERN, r"""\(\s*SELECT\b[^)]+\bORDER\s+BY\b"""),
    Rule("PERF-AGG-003", "HAVING Without GROUP BY", MEDIUM, "", NODE),
    Rule("PERF-BATCH-001", "Large Unbatched Operation", HIGH, "", NODE),
    Rule("PERF-BATCH-002", "Missing Batch Size in Loop", MEDIUM, "", PATTERN, r"""\bWHILE\b[\s\S]*?\b(UPDATE|DELETE)\b(?![\s\S]*?\b(TOP|LIMIT)\b)[\s\S]*?\bEND\b"""),
    Rule("PERF-CH-001", "SELECT Without PREWHERE", INFO, "clickhouse", PATTERN, r"""\bSELECT\b.*\bWHERE\b(?!.*\bPREWHERE\b)"""),
    Rule("PERF-CH-002", "JOIN Without GLOBAL on Distributed Table", MEDIUM, "clickhouse", TEXT),
    Rule("PERF-CH-003", "ClickHouse Mutation (ALTER UPDATE/DELETE)", MEDIUM, "clickhouse", PATTERN, r"""\bALTER\s+TABLE\s+\w+\s+(?:UPDATE|DELETE)\b"""),
    Rule("PERF-CURSOR-001", "Cursor Declaration", HIGH, "", PATTERN, r"""\bDECLARE\s+\w+\s+CURSOR\b"""),
    Rule("PERF-CURSOR-002", "WHILE Loop Pattern", MEDIUM, "tsql", PATTERN, r"""\bWHILE\s+[\(@].*\bBEGIN\b"""),
    Rule("PERF-CURSOR-003", "Nested Loop Join Hint", LOW, "tsql", PATTERN, r"""\b(LOOP\s+JOIN|INNER\s+LOOP\s+JOIN|LEFT\s+LOOP\s+JOIN|OPTION\s*\(\s*LOOP\s+JOIN\s*\))"""),
    Rule("PERF-DUCK-001", "COPY Without FORMAT Specification", MEDIUM, "duckdb", PATTERN, r"""\bCOPY\b(?!.*\bFORMAT\b)"""),
    Rule("PERF-DUCK-002", "Large IN List — Use VALUES Table", LOW, "duckdb", PATTERN, r"""\bIN\s*\(\s*(?:[^()]*,\s*){9,}"""),
    Rule("PERF-SCALAR-001", "Scalar UDF in SELECT/WHERE", HIGH, "tsql", PATTERN, r"""\b(SELECT|WHERE)\b[^;]*\bdbo\.\w+\s*\([^)]*\)"""),
    Rule("PERF-SCALAR-002", "Correlated Subquery", MEDIUM, "", NODE),
    Rule("PERF-SORT-001", "ORDER BY on Non-Indexed Column", LOW, "", NODE),
    Rule("PERF-HINT-001", "Query Optimizer Hint", LOW, "tsql", PATTERN, r"""\bOPTION\s*\(\s*(FORCE\s+ORDER|HASH\s+JOIN|MERGE\s+JOIN|LOOP\s+JOIN|FAST\s+\d+|RECOMPILE|OPTIMIZE\s+FOR|MAXDOP|QUERYTRACEON|USE\s+PLAN)\b"""),
    Rule("PERF-HINT-002", "Index Hint", LOW, "mysql,tsql", PATTERN, r"""\b(FORCE\s+INDEX|USE\s+INDEX|IGNORE\s+INDEX|WITH\s*\(\s*INDEX\s*[=(])\b"""),
    Rule("PERF-HINT-003", "Parallel Query Hint", INFO, "tsql", PATTERN, r"""\bOPTION\s*\([^)]*MAXDOP\s+\d+"""),
    Rule("PERF-IDX-002", "Leading Wildcard Search", HIGH, "", PATTERN, r"""\s+LIKE\s+['\"]%[^'\"]+['\"]"""),
    Rule("PERF-IDX-001", "Function on Indexed Column", MEDIUM, "", NODE),
    Rule("PERF-IDX-004", "OR in WHERE Clause", INFO, "", PATTERN, r"""\bWHERE\b.+\bOR\b"""),
    Rule("PERF-IDX-005", "Deep Offset Pagination", HIGH, "", PATTERN, r"""\bOFFSET\s+([1-9]\d{3,})\b"""),
    Rule("PERF-IDX-003", "Implicit Type Conversion on Indexed Column", HIGH, "", NODE),
    Rule("PERF-IDX-006", "Composite Index Column Order Violation", MEDIUM, "", NODE),
    Rule("PERF-IDX-007", "Non-SARGable OR Condition", MEDIUM, "", NODE),
    Rule("PERF-IDX-008", "COALESCE/ISNULL/NVL on Indexed Column", MEDIUM, "", PATTERN, r"""\bWHERE\b(?:(?!\bGROUP\s+BY\b|\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b|\bINTO\b|\bFOR\b).)*\b(COALESCE|ISNULL|NVL|NVL2|IFNULL)\s*\(\s*\w+"""),
    Rule("PERF-IDX-009", "Negation on Indexed Column (NOT, !=, <>)", LOW, "", NODE),
    Rule("PERF-PG-001", "ILIKE Disables Index", MEDIUM, "postgresql", PATTERN, r"""\bILIKE\b"""),
    Rule("PERF-JOIN-001", "Cartesian Product (CROSS JOIN)", HIGH, "", NODE),
    Rule("PERF-JOIN-002", "Excessive Joins", MEDIUM, "", NODE),
    Rule("PERF-JOIN-003", "LEFT JOIN With IS NOT NULL Filter", LOW, "", NODE),
    Rule("PERF-LOCK-001", "Table Lock Hint", HIGH, "tsql", PATTERN, r"""\bWITH\s*\(\s*(TABLOCK|TABLOCKX|HOLDLOCK|XLOCK|PAGLOCK|ROWLOCK|UPDLOCK|SERIALIZABLE)\s*\)"""),
    Rule("PERF-LOCK-002", "NOLOCK / Read Uncommitted Hint", MEDIUM, "tsql", PATTERN, r"""\bWITH\s*\(\s*(NOLOCK|READUNCOMMITTED)\s*\)|\bREAD\s+UNCOMMITTED\b|\bSET\s+TRANSACTION\s+ISOLATION\s+LEVEL\s+READ\s+UNCOMMITTED\b"""),
    Rule("PERF-LOCK-003", "Long Transaction Pattern", HIGH, "", PATTERN, r"""\bBEGIN\s+(TRAN|TRANSACTION)\b[\s\S]{500,}?\b(COMMIT|ROLLBACK)\b"""),
    Rule("PERF-LOCK-004", "Missing Transaction Isolation Level", INFO, "", NODE),
    Rule("PERF-ORA-001", "SELECT FOR UPDATE Without NOWAIT (Oracle)", MEDIUM, "oracle", TEXT),
    Rule("PERF-MEM-001", "Large IN Clause", MEDIUM, "", NODE),
    Rule("PERF-MEM-002", "Unbounded Temp Table Creation", MEDIUM, "tsql", PATTERN, r"""\bSELECT\b(?!.*\b(WHERE|TOP|LIMIT)\b)[^;]*\bINTO\s+[#@\w]+"""),
    Rule("PERF-MEM-003", "ORDER BY Without LIMIT in Subquery", LOW, "", NODE),
    Rule("PERF-MEM-004", "GROUP BY on High-Cardinality Expression", LOW, "", NODE),
    Rule("PERF-TSQL-002", "SELECT INTO Temp Table Without Index", MEDIUM, "tsql", TEXT),
    Rule("PERF-TSQL-003", "Implicit Conversion in JOIN Predicate", HIGH, "tsql", PATTERN, r"""\bJOIN\b.*\bCONVERT\s*\(|\bCAST\s*\(.*\bJOIN\b"""),
    Rule("PERF-NET-001", "Excessive Column Count in SELECT", LOW, "", NODE),
    Rule("PERF-NET-002", "Large Object Column in Non-Filtered Query", MEDIUM, "", NODE),
    Rule("PERF-TSQL-001", "Missing SET NOCOUNT ON", INFO, "tsql", TEXT),
    Rule("PERF-PRESTO-001", "Implicit Cross-Join on Distributed Engine", HIGH, "presto,trino", PATTERN, r"""\bFROM\s+\w+\s*,\s*\w+\b(?!.*\bJOIN\b)"""),
    Rule("PERF-PRESTO-002", "ORDER BY Without LIMIT on Distributed Engine", MEDIUM, "presto,trino", TEXT),
    Rule("PERF-RS-001", "SELECT * on Redshift Columnar Storage", HIGH, "redshift", PATTERN, r"""\bSELECT\s+\*"""),
    Rule("PERF-RS-002", "ORDER BY Without LIMIT on Redshift", MEDIUM, "redshift", TEXT),
    Rule("PERF-RS-003", "NOT IN on Redshift (Hash Join Explosion)", MEDIUM, "redshift", PATTERN, r"""\bNOT\s+IN\s*\(\s*SELECT\b"""),
    Rule("PERF-SCAN-001", "SELECT * Usage", MEDIUM, "", NODE),
    Rule("PERF-SCAN-002", "Unbounded Data Modification", HIGH, "", NODE),
    Rule("PERF-SCAN-005", "Expensive DISTINCT", LOW, "", NODE),
    Rule("PERF-SCAN-003", "Unbounded SELECT", LOW, "", NODE),
    Rule("PERF-SCAN-004", "NOT IN Subquery", MEDIUM, "", NODE),
    Rule("PERF-PG-002", "Unfiltered COUNT(*) — Consider reltuples", INFO, "postgresql", TEXT),
    Rule("PERF-PG-003", "NOT IN With Potentially NULLable Subquery", MEDIUM, "postgresql", TEXT),
    Rule("PERF-PG-004", "SELECT FOR UPDATE Without NOWAIT/SKIP LOCKED (PG)", LOW, "postgresql", TEXT),
    Rule("PERF-MYSQL-001", "SELECT FOR UPDATE Without LIMIT (MySQL)", MEDIUM, "mysql", TEXT),
    Rule("PERF-MYSQL-002", "ORDER BY RAND() Full Table Sort", HIGH, "mysql", PATTERN, r"""\bORDER\s+BY\s+RAND\s*\(\s*\)"""),
    Rule("PERF-MYSQL-003", "FORCE INDEX / USE INDEX Hint", LOW, "mysql", PATTERN, r"""\b(?:FORCE|USE|IGNORE)\s+INDEX\s*\("""),
    Rule("PERF-BQ-001", "SELECT DISTINCT on UNNEST", MEDIUM, "bigquery", PATTERN, r"""\bSELECT\s+DISTINCT\b.*\bUNNEST\s*\("""),
    Rule("PERF-BQ-002", "REGEXP on Large Table Without Filter", LOW, "bigquery", PATTERN, r"""\bREGEXP_(?:CONTAINS|EXTRACT|REPLACE)\s*\("""),
    Rule("PERF-SPARK-001", "BROADCAST Hint on Large Table", HIGH, "spark,databricks", PATTERN, r"""/\*\+\s*BROADCAST\s*\("""),
    Rule("PERF-SPARK-002", "UDF in WHERE Prevents Pushdown", MEDIUM, "spark,databricks", TEXT),
    Rule("PERF-SQLITE-001", "Consider WAL Mode for Concurrent Access", INFO, "sqlite", PATTERN, r"""\bPRAGMA\s+journal_mode\s*=\s*(?!wal\b)\w+"""),
    Rule("PERF-SQLITE-002", "LIKE Without COLLATE NOCASE", LOW, "sqlite", PATTERN, r"""\bLIKE\s+'[^']*'"""),
    Rule("QUAL-SQLITE-001", "AUTOINCREMENT Overhead in SQLite", LOW, "sqlite", PATTERN, r"""\bAUTOINCREMENT\b"""),
]
# fmt: on
