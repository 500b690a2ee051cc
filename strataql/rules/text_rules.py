"""Conditions of the rules that look at a statement's text as a whole."""

from __future__ import annotations

from strataql.functions.predicates import Pred, counted, has, matches, typed

#: Rules that are no part of the catalogue but of an analyzer: id, severity, condition.
UNFILTERED_COUNT = "COST-COMP-002"

_SELECT = typed(("SELECT",))

CONDITIONS: dict[str, Pred] = {
    "COST-BQ-003": counted(2, r"(?i)\(\s*SELECT\s+") & ~(has("WITH") & has("AS")),
    "COST-SPARK-001": typed(("SELECT", "DELETE", "UPDATE")) & has("SELECT") & ~has("WHERE"),
    "PERF-CH-002": has("JOIN") & ~has("GLOBAL") & matches(r"\bJOIN\s*\(\s*SELECT\b"),
    "PERF-ORA-001": has("FOR UPDATE") & ~has("NOWAIT", "SKIP LOCKED", "WAIT"),
    "PERF-TSQL-002": matches(r"\bSELECT\b.*\bINTO\s+#") & ~has("CREATE INDEX", "CREATE UNIQUE INDEX"),
    "PERF-TSQL-001": matches(r"\bCREATE\s+(?:OR\s+ALTER\s+)?PROC(?:EDURE)?\b") & ~has("SET NOCOUNT ON"),
    "PERF-PRESTO-002": _SELECT & has("ORDER BY") & ~has("LIMIT"),
    "PERF-RS-002": _SELECT & has("ORDER BY") & ~has("LIMIT", "TOP"),
    "PERF-PG-002": _SELECT & has("COUNT(*)", "COUNT( *)") & ~has("WHERE"),
    "PERF-PG-003": matches(r"\bNOT\s+IN\s*\(\s*SELECT\b"),
    "PERF-PG-004": has("FOR UPDATE") & ~has("NOWAIT", "SKIP LOCKED"),
    "PERF-MYSQL-001": has("FOR UPDATE") & ~has("LIMIT"),
    "PERF-SPARK-002": matches(r"\bWHERE\b.*\budf\s*\("),
    "QUAL-COMPLEX-005": counted(50, "\n"),
    "QUAL-DOC-003": counted(5, "AND", "OR", "CASE") & ~has("--", "/*"),
    "QUAL-CH-001": _SELECT & has("ORDER BY") & ~has("LIMIT"),
    "REL-CH-001": _SELECT & has("REPLACING", "COLLAPSING") & ~has("FINAL"),
    "REL-PG-001": matches(r"\bALTER\s+TABLE\b.*\bADD\s+(?:COLUMN\s+)?\w+") & has("DEFAULT") & has("NOW()", "CURRENT_TIMESTAMP", "RANDOM()", "GEN_RANDOM_UUID()", "CLOCK_TIMESTAMP()"),
    "REL-TSQL-003": has("TRUNCATE") & has("BEGIN TRY") & ~has("BEGIN CATCH"),
    "REL-ORA-002": matches(r"\bALTER\s+TABLE\b.*\bMOVE\b") & ~has("REBUILD"),
    "REL-BQ-001": typed(("UPDATE", "DELETE"), or_unknown=False) & ~has("WHERE"),
    "REL-PRESTO-001": matches(r"\bINSERT\s+OVERWRITE\b") & ~has("PARTITION"),
    "REL-SPARK-001": matches(r"\bINSERT\s+OVERWRITE\b") & ~has("PARTITION"),
    "REL-TSQL-002": matches(r"\bMERGE\b") & ~has("HOLDLOCK", "SERIALIZABLE"),
    "REL-ORA-001": matches(r"\bCONNECT\s+BY\b") & ~has("NOCYCLE"),
    # Structural rules of the catalogue whose whole condition is on the text.
    "PERF-LOCK-004": has("BEGIN TRAN") & ~has("ISOLATION LEVEL"),
    "REL-RACE-001": has("SELECT") & has("UPDATE") & ~has("FOR UPDATE", "SERIALIZABLE"),
    UNFILTERED_COUNT: typed(("SELECT",), or_unknown=False) & has("COUNT") & ~has("WHERE"),
}

# Statement-level forms "A and not B" of patterns with lookaround, for engines without it.
WITHOUT_LOOKAROUND: dict[str, tuple[str, str]] = {
    "PERF-SQLITE-001": (r"\bPRAGMA\s+journal_mode\s*=\s*\w+", r"\bPRAGMA\s+journal_mode\s*=\s*wal\b"),
    "REL-PG-002": (r"\bCREATE\s+(?:UNIQUE\s+)?INDEX\s+\w+", r"\bCREATE\s+(?:UNIQUE\s+)?INDEX\s+CONCURRENTLY\b"),
    "QUAL-STYLE-001": (r"^\s*SELECT\b[\s\S]+$", r"\bSELECT\b[\s\S]*\bFROM\b"),
    "COST-MYSQL-001": (r"\bSELECT\s+.*\b(?:GROUP\s+BY|ORDER\s+BY|HAVING)\b", r"\bSELECT\s+.*\bSQL_NO_CACHE\b"),
    "REL-RETRY-001": (r"\bBEGIN\s+(TRAN|TRANSACTION)\b[\s\S]*?\b(COMMIT|ROLLBACK)\b", r"\bBEGIN\s+(TRAN|TRANSACTION)\b[\s\S]*\b(TRY|CATCH|EXCEPTION|RETRY|ATTEMPT|LOOP|WHILE)\b"),
    "REL-DATA-002": (r"\bTRUNCATE\s+TABLE\b|\bTRUNCATE\b\s*(?:[^\s\w-]|\w|-[^-]|$)", ""),
    "QUAL-SCHEMA-001": (r"CREATE\s+TABLE\s+.*?(?:\);|\z)", r"CREATE\s+TABLE\s+.*PRIMARY\s+KEY"),
    "QUAL-DOC-001": (r"CREATE\s+TABLE\s+.*?(?:\);|\z)", r"CREATE\s+TABLE\s+.*COMMENT"),
    "PERF-IDX-008": (r"\bWHERE\b.*\b(COALESCE|ISNULL|NVL|NVL2|IFNULL)\s*\(\s*\w+", r"\bWHERE\b.*\b(GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|UNION|INTERSECT|EXCEPT|INTO|FOR)\b.*\b(COALESCE|ISNULL|NVL|NVL2|IFNULL)\s*\("),
    "QUAL-NULL-001": (r"(?:^|[^A-Z_])\s*=\s*NULL\b|\bNULL\s*=\s*(?:[^A-Z_]|$)|!=\s*NULL\b|<>\s*NULL\b", ""),
    "PERF-BATCH-002": (r"\bWHILE\b[\s\S]*?\b(UPDATE|DELETE)\b[\s\S]*?\bEND\b", r"\b(UPDATE|DELETE)\b[\s\S]*?\b(TOP|LIMIT)\b"),
    "REL-STALE-001": (r"^.*?(INSERT|UPDATE)\s+[^;]+;\s*SELECT\s+[^;]+FROM\s+(\w+)", r"^.*?\bBEGIN\b"),
    "REL-DEAD-001": (r"\bBEGIN\b[\s\S]*?\bUPDATE\s+(\w+)\b[\s\S]*?\bUPDATE\s+(\w+)\b[\s\S]*?\bCOMMIT\b", ""),
}
#: No such form is exact on real statements for these; they are compared with brute force in the tests only.
NO_FORM = frozenset({"COST-COMPUTE-001", "PERF-MEM-002", "QUAL-DRY-001", "QUAL-DEBT-002", "QUAL-DOC-002"})
