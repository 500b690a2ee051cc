"""Rules on schemas and their history."""

from __future__ import annotations

from strataql.rules.spec import CRITICAL, HIGH, MEDIUM, SCHEMA, Rule

# Ids, names and severities of the catalogue.
RULES = [
    Rule("MIG-BRK-001", "Breaking Schema Change", HIGH, "", SCHEMA),
    Rule("SCHEMA-COL-001", "Non-Existent Column", CRITICAL, "", SCHEMA),
    Rule("SCH-BRK-001", "Cross-File Breaking Change", HIGH, "", SCHEMA),
    Rule("SCHEMA-IDX-001", "Missing Index on WHERE Column", MEDIUM, "", SCHEMA),
    Rule("SCHEMA-TBL-001", "Non-Existent Table", CRITICAL, "", SCHEMA),
]
