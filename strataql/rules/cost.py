"""Cost rules."""

from __future__ import annotations

from strataql.rules.spec import CRITICAL, HIGH, INFO, LOW, MEDIUM, NODE, PATTERN, TEXT, Rule

# Ids, names, severities, dialects (none: all) and patterns of the catalogue.
# fmt: off
RULES = [
    Rule("COST-BQ-001", "SELECT * in BigQuery Scans All Columns", HIGH, "bigquery", PATTERN, r"""\bSELECT\s+\*"""),
    Rule("COST-BQ-002", "BigQuery Query Without LIMIT", MEDIUM, "bigquery", PATTERN, r"""\bSELECT\b(?![\s\S]*\bLIMIT\b)"""),
    Rule("COST-BQ-003", "Repeated Subquery Instead of CTE", MEDIUM, "bigquery", TEXT),
    Rule("COST-CH-001", "SELECT * on ClickHouse Columnar Storage", HIGH, "clickhouse", PATTERN, r"""\bSELECT\s+\*"""),
    Rule("COST-COMPUTE-001", "Full Table Scan on Large Tables", HIGH, "", PATTERN, r"""\bSELECT\b(?!\s+\*\s+INTO\b).*?\bFROM\b(?:(?!\bWHERE\b).)*?(?:;|$)"""),
    Rule("COST-COMPUTE-002", "Expensive Window Functions Without Partitioning", MEDIUM, "", NODE),
    Rule("COST-SF-003", "LATERAL FLATTEN Without Warehouse Consideration", INFO, "snowflake", PATTERN, r"""\bLATERAL\s+FLATTEN\b"""),
    Rule("COST-MYSQL-001", "Query Cache Pollution", LOW, "mysql", PATTERN, r"""\bSELECT\s+(?!.*\bSQL_NO_CACHE\b).*\b(?:GROUP\s+BY|ORDER\s+BY|HAVING)\b"""),
    Rule("COST-TSQL-001", "Cursor Without FAST_FORWARD", MEDIUM, "tsql", PATTERN, r"""\bDECLARE\s+\w+\s+CURSOR\b(?!.*\bFAST_FORWARD\b)"""),
    Rule("COST-ORA-001", "Full Table Scan Hint", MEDIUM, "oracle", PATTERN, r"""/\*\+\s*FULL\s*\("""),
    Rule("COST-CROSS-001", "Cross-Database JOIN", HIGH, "", NODE),
    Rule("COST-CROSS-002", "Multi-Region Query Latency", MEDIUM, "", PATTERN, r"""\b(SELECT|INSERT|UPDATE|DELETE)\b[^;]*\b(us-east|us-west|eu-west|ap-south|@[^.]*\..*\.rds\.amazonaws\.com|@[^.]*\.database\.windows\.net)\b"""),
    Rule("COST-CROSS-003", "Distributed Transaction Overhead", HIGH, "", PATTERN, r"""\b(BEGIN\s+DISTRIBUTED\s+TRANSACTION|XA\s+START|START\s+TRANSACTION\s+WITH\s+CONSISTENT\s+SNAPSHOT)\b"""),
    Rule("COST-IDX-001", "Duplicate Index Signal", MEDIUM, "", PATTERN, r"""\bCREATE\s+INDEX\s+\w+\s+ON\s+(\w+)\s*\(([^)]+)\)"""),
    Rule("COST-IDX-002", "Over-Indexed Table Signal", LOW, "", PATTERN, r"""(CREATE\s+INDEX\s+\w+\s+ON\s+(\w+)[\s\S]*?){3,}"""),
    Rule("COST-IDX-003", "Missing Covering Index Opportunity", LOW, "", NODE),
    Rule("COST-IDX-004", "Redundant Index Column Order", INFO, "", PATTERN, r"""\bCREATE\s+INDEX\s+\w+\s+ON\s+\w+\s*\((\w+)\s*,\s*(\w+)"""),
    Rule("COST-IO-001", "Redundant ORDER BY in Subqueries", LOW, "", NODE),
    Rule("COST-ARCHIVE-001", "Old Data Not Archived", LOW, "", NODE),
    Rule("COST-COMPRESS-001", "Large Text Column Without Compression", LOW, "", PATTERN, r"""\bCREATE\s+TABLE\b[^;]*\b(VARCHAR\s*\(\s*\d{4,}\)|TEXT|CLOB|NVARCHAR\s*\(MAX\)|LONGTEXT)\b"""),
    Rule("COST-PARTITION-001", "Large Table Without Partitioning", MEDIUM, "", NODE),
    Rule("COST-NETWORK-001", "Cross-Region Data Transfer", INFO, "", PATTERN, r"""\b(OPENQUERY|OPENDATASOURCE|EXTERNAL\s+TABLE|DBLink|@[\w\.]+)\b"""),
    Rule("COST-PAGE-001", "OFFSET Pagination Without Index", HIGH, "", NODE),
    Rule("COST-PAGE-002", "Deep Pagination Without Cursor", MEDIUM, "", NODE),
    Rule("COST-PAGE-003", "COUNT(*) for Pagination Total", MEDIUM, "", PATTERN, r"""\bSELECT\s+COUNT\s*\(\s*\*\s*\)\s+FROM\b(?!.*\b(WHERE|LIMIT|TOP)\b)"""),
    Rule("COST-PRESTO-001", "SELECT * on Partitioned Hive Table", HIGH, "presto,trino", PATTERN, r"""\bSELECT\s+\*"""),
    Rule("COST-RS-001", "UNLOAD Without PARALLEL Consideration", MEDIUM, "redshift", PATTERN, r"""\bUNLOAD\b(?!.*\bPARALLEL\b)"""),
    Rule("COST-SERVERLESS-001", "Cold Start Query Pattern", MEDIUM, "", PATTERN, r"""\bSELECT\b.*\b(JOIN|UNION|INTERSECT|EXCEPT)\b.*\b(GROUP\s+BY|ORDER\s+BY|DISTINCT)\b"""),
    Rule("COST-SERVERLESS-002", "Unnecessary Connection Pooling", INFO, "", PATTERN, r"""\b(SET\s+SESSION|CONNECTION\s+TIMEOUT\s*=\s*\d{4,}|KEEP\s+ALIVE|POOLING\s*=\s*TRUE)\b"""),
    Rule("COST-SF-001", "SELECT * Wastes Snowflake Credits", MEDIUM, "snowflake", PATTERN, r"""\bSELECT\s+\*"""),
    Rule("COST-SF-002", "COPY INTO Without Explicit File Format", MEDIUM, "snowflake", PATTERN, r"""\bCOPY\s+INTO\b(?![\s\S]*\bFILE_FORMAT\b)"""),
    Rule("REL-SF-001", "COPY INTO Without ON_ERROR", HIGH, "snowflake", PATTERN, r"""\bCOPY\s+INTO\b(?!.*\bON_ERROR\b)"""),
    Rule("PERF-SF-001", "VARIANT Column in WHERE Without CAST", MEDIUM, "snowflake", PATTERN, r"""\bWHERE\b.*:[\w.]+"""),
    Rule("PERF-SF-002", "ORDER BY on VARIANT Column", LOW, "snowflake", PATTERN, r"""\bORDER\s+BY\b.*:[\w.]+"""),
    Rule("COST-SPARK-001", "Full Scan Without Partition Filter", MEDIUM, "spark,databricks", TEXT),
    Rule("COST-SPARK-002", "CACHE TABLE Without Filter", MEDIUM, "spark,databricks", PATTERN, r"""\bCACHE\s+(?:LAZY\s+)?TABLE\b(?!.*\bWHERE\b|.*\bOPTIONS\b)"""),
    Rule("COST-STORAGE-001", "SELECT * in ETL/CTAS Queries", MEDIUM, "", NODE),
]
# fmt: on
