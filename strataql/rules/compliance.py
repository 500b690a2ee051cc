"""Compliance rules."""

from __future__ import annotations

from strataql.rules.spec import CRITICAL, HIGH, INFO, LOW, MEDIUM, NODE, PATTERN, TEXT, Rule

# Ids, names, severities, dialects (none: all) and patterns of the catalogue.
# fmt: off
RULES = [
    Rule("COMP-CCPA-001", "Do Not Sell Flag Not Checked", HIGH, "", NODE),
    Rule("COMP-GDPR-001", "Potential PII Selection", MEDIUM, "", PATTERN, r"""\b(email|ssn|social_security|credit_card|cc_num|passport)\b"""),
    Rule("COMP-GDPR-002", "Potential Cross-Border Data Transfer", MEDIUM, "", PATTERN, r"""\bDBLINK\s*\(|\bOPENROWSET\s*\(|\bCREATE\s+SERVER\b|\bCREATE\s+FOREIGN\s+TABLE\b"""),
    Rule("COMP-GDPR-003", "Right to Erasure — Verify Cascade Completeness", INFO, "", PATTERN, r"""\bDELETE\s+FROM\s+(users|customers|accounts|profiles|members|user_data|customer_data|personal_data)\b"""),
    Rule("COMP-GDPR-004", "Marketing Insert Without Consent Signal", MEDIUM, "", PATTERN, r"""\bINSERT\s+INTO\s+\w*(marketing|newsletter|mailing_list|campaign|subscribers|email_list)\w*\b"""),
    Rule("COMP-GDPR-005", "Data Subject Request Without Completeness Check", MEDIUM, "", NODE),
    Rule("COMP-GDPR-006", "Consent Withdrawal Not Honored", HIGH, "", NODE),
    Rule("COMP-SEC-001", "Unencrypted Sensitive Column Definition", HIGH, "", PATTERN, r"""\bCREATE\s+TABLE\b.+\b(password|secret|token|ssn|credit_card|cvv|pin)\b.+\b(VARCHAR|TEXT|CHAR)\b"""),
    Rule("COMP-RET-001", "Missing Retention Policy Signal", LOW, "", PATTERN, r"""\bCREATE\s+TABLE\b.+\b(audit|audits|audit_log|event_log|history|logs|access_log|activity_log)\b"""),
    Rule("COMP-AUD-001", "Audit Log Tampering Risk", HIGH, "", PATTERN, r"""\b(DELETE\s+FROM|UPDATE)\s+\w*(audit|audit_log|event_log|access_log|activity_log|audit_trail|system_log)\w*\b"""),
    Rule("COMP-HIPAA-001", "PHI Access Without Audit Trail", HIGH, "", NODE),
    Rule("COMP-HIPAA-002", "PHI Minimum Necessary Violation", MEDIUM, "", NODE),
    Rule("COMP-HIPAA-003", "Unencrypted PHI Transit Signal", HIGH, "", PATTERN, r"""\b(encrypt=false|trustServerCertificate=true|sslmode=disable|ssl_mode=none)\b.*?\b(patients|medical_records|phi|health|ehr)\b"""),
    Rule("COMP-PCI-001", "PAN Exposure in SQL", HIGH, "", PATTERN, r"""\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9][0-9])[0-9]{12})\b"""),
    Rule("COMP-PCI-002", "CVV Storage Violation", CRITICAL, "", PATTERN, r"""\b(INSERT|CREATE)\b.*?\b(cvv|cvc|cid|security_code|card_verification)\b"""),
    Rule("COMP-PCI-003", "Data Retention Violation", MEDIUM, "", PATTERN, r"""\bSELECT\b.*?\bFROM\b.*?\b(transactions|cardholder_data|payments)\b(?!.*?\bWHERE\b.*?\b(date|created_at|timestamp|retention)\b)"""),
    Rule("COMP-SOX-001", "Financial Data Modification Without Change Tracking", HIGH, "", NODE),
    Rule("COMP-SOX-002", "Segregation of Duties Violation", HIGH, "", PATTERN, r"""\bUPDATE\s+.*?\bSET\s+.*?\b(approved_by|status)\b.*?\bWHERE\b.*?\bcreated_by\b"""),
]
# fmt: on
