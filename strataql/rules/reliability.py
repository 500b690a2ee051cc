"""Reliability rules."""

from __future__ import annotations

from strataql.rules.spec import CRITICAL, HIGH, INFO, LOW, MEDIUM, NODE, PATTERN, TEXT, Rule

# Ids, names, severities, dialects (none: all) and patterns of the catalogue.
# fmt: off
RULES = [
    Rule("REL-CH-001", "SELECT Without FINAL on ReplacingMergeTree", HIGH, "clickhouse", TEXT),
    Rule("REL-DATA-001", "Catastrophic Data Loss Risk", CRITICAL, "", NODE),
    Rule("REL-DATA-004", "Destructive Schema Change (DROP)", HIGH, "", NODE),
    Rule("REL-DATA-002", "Truncate Without Transaction", HIGH, "", PATTERN, r"""\bTRUNCATE\s+TABLE\b|\bTRUNCATE\b(?!\s*--)"""),
    Rule("REL-DATA-003", "ALTER TABLE Without Backup Signal", MEDIUM, "", PATTERN, r"""\bALTER\s+TABLE\b.+\bDROP\s+COLUMN\b|\bALTER\s+TABLE\b.+\bMODIFY\s+COLUMN\b|\bALTER\s+TABLE\b.+\bRENAME\s+COLUMN\b|\bALTER\s+TABLE\b.+\bCHANGE\s+COLUMN\b"""),
    Rule("REL-MYSQL-001", "INSERT IGNORE Silences Errors", HIGH, "mysql", PATTERN, r"""\bINSERT\s+IGNORE\b"""),
    Rule("REL-MYSQL-002", "REPLACE INTO Deletes and Reinserts", HIGH, "mysql", PATTERN, r"""\bREPLACE\s+INTO\b"""),
    Rule("REL-MYSQL-003", "MySQL utf8 Instead of utf8mb4", MEDIUM, "mysql", PATTERN, r"""\b(?:CHARACTER\s+SET|CHARSET|DEFAULT\s+CHARSET)\s*=?\s*utf8\b(?!mb4)"""),
    Rule("REL-TSQL-001", "@@IDENTITY Instead of SCOPE_IDENTITY()", HIGH, "tsql", PATTERN, r"""@@IDENTITY\b"""),
    Rule("REL-PG-002", "CREATE INDEX Without CONCURRENTLY", HIGH, "postgresql", PATTERN, r"""\bCREATE\s+(?:UNIQUE\s+)?INDEX\s+(?!CONCURRENTLY\b)\w+"""),
    Rule("REL-PG-001", "ALTER TABLE ADD COLUMN With Volatile DEFAULT", HIGH, "postgresql", TEXT),
    Rule("REL-TSQL-003", "TRUNCATE in TRY Without CATCH", HIGH, "tsql", TEXT),
    Rule("REL-ORA-002", "ALTER TABLE MOVE Without REBUILD INDEX", HIGH, "oracle", TEXT),
    Rule("REL-BQ-001", "DML Without WHERE on BigQuery", HIGH, "bigquery", TEXT),
    Rule("REL-MYSQL-005", "MyISAM Engine Usage", MEDIUM, "mysql", PATTERN, r"""\bENGINE\s*=\s*MyISAM\b"""),
    Rule("REL-DEAD-001", "Deadlock Pattern", HIGH, "", PATTERN, r"""\bBEGIN\b[\s\S]*?\bUPDATE\s+(\w+)\b[\s\S]*?\bUPDATE\s+(?!\1)(\w+)\b[\s\S]*?\bCOMMIT\b"""),
    Rule("REL-DEAD-002", "Lock Escalation Risk", MEDIUM, "", NODE),
    Rule("REL-ERR-001", "Swallowed Exception Pattern", MEDIUM, "", PATTERN, r"""\bWHEN\s+OTHERS\s+THEN\s+NULL\b"""),
    Rule("REL-REC-001", "Missing Savepoint in Long Transaction", INFO, "", PATTERN, r"""\bSAVEPOINT\b"""),
    Rule("REL-FK-001", "Orphan Record Risk", MEDIUM, "", NODE),
    Rule("REL-FK-002", "Cascade Delete Risk", HIGH, "", PATTERN, r"""\bDELETE\s+FROM\s+(users|customers|accounts|orders|products|categories|departments|companies|tenants|organizations)\b(?!.*\bCASCADE\s*=\s*FALSE\b)"""),
    Rule("REL-MYSQL-004", "ON UPDATE CASCADE With Timestamp Column", MEDIUM, "mysql", PATTERN, r"""\bON\s+UPDATE\s+CASCADE\b"""),
    Rule("REL-IDEM-001", "Non-Idempotent INSERT Pattern", HIGH, "", NODE),
    Rule("REL-IDEM-002", "Non-Idempotent UPDATE Pattern", MEDIUM, "", NODE),
    Rule("REL-PRESTO-001", "INSERT OVERWRITE Without Partition", CRITICAL, "presto,trino", TEXT),
    Rule("REL-RACE-001", "Read-Modify-Write Without Lock", HIGH, "", NODE),
    Rule("REL-RACE-002", "TOCTOU Pattern", HIGH, "", PATTERN, r"""\bIF\s+(NOT\s+)?EXISTS\s*\(\s*SELECT[^)]+\)[^;]*\b(INSERT|UPDATE|DELETE)\b"""),
    Rule("REL-TSQL-002", "MERGE Without HOLDLOCK", HIGH, "tsql", TEXT),
    Rule("REL-RS-001", "COPY Without MANIFEST", HIGH, "redshift", PATTERN, r"""\bCOPY\b.*\bFROM\b.*\bs3://(?!.*\bMANIFEST\b)"""),
    Rule("REL-SPARK-001", "INSERT OVERWRITE Without Partition", CRITICAL, "spark,databricks", TEXT),
    Rule("REL-SQLITE-001", "ALTER TABLE DROP COLUMN (SQLite Limitation)", MEDIUM, "sqlite", PATTERN, r"""\bALTER\s+TABLE\s+\w+\s+DROP\s+COLUMN\b"""),
    Rule("REL-SQLITE-002", "PRAGMA foreign_keys = OFF", HIGH, "sqlite", PATTERN, r"""\bPRAGMA\s+foreign_keys\s*=\s*(?:OFF|0|false)\b"""),
    Rule("REL-TIMEOUT-001", "Long-Running Query Risk", MEDIUM, "", NODE),
    Rule("REL-STALE-001", "Stale Read Risk", MEDIUM, "", PATTERN, r"""^(?!.*?\bBEGIN\b).*?(INSERT|UPDATE)\s+[^;]+;\s*SELECT\s+[^;]+FROM\s+(\w+)"""),
    Rule("REL-RETRY-001", "Missing Retry Logic", INFO, "", PATTERN, r"""\bBEGIN\s+(TRAN|TRANSACTION)\b(?![\s\S]*\b(TRY|CATCH|EXCEPTION|RETRY|ATTEMPT|LOOP|WHILE)\b)[\s\S]*?\b(COMMIT|ROLLBACK)\b"""),
    Rule("REL-ORA-001", "CONNECT BY Without NOCYCLE", HIGH, "oracle", TEXT),
    Rule("REL-TXN-001", "Missing Transaction Rollback Handler", INFO, "", PATTERN, r"""\b(BEGIN|START\s+TRANSACTION)\b"""),
    Rule("REL-TXN-002", "Autocommit Disable Detection", LOW, "", PATTERN, r"""\bSET\s+autocommit\s*=\s*0\b|\bSET\s+IMPLICIT_TRANSACTIONS\s+ON\b"""),
    Rule("REL-TXN-003", "Empty Transaction Block", MEDIUM, "", PATTERN, r"""\b(?:BEGIN|START\s+TRANSACTION)\s*;\s*(?:COMMIT|END)\b"""),
    Rule("REL-ORA-003", "PRAGMA AUTONOMOUS_TRANSACTION", HIGH, "oracle", PATTERN, r"""\bPRAGMA\s+AUTONOMOUS_TRANSACTION\b"""),
]
# fmt: on
