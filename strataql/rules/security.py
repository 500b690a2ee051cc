"""Security rules."""

from __future__ import annotations

from strataql.rules.spec import CRITICAL, HIGH, INFO, LOW, MEDIUM, NODE, PATTERN, TEXT, Rule

# Ids, names, severities, dialects (none: all) and patterns of the catalogue.
# fmt: off
RULES = [
    Rule("SEC-AUTH-001", "Hardcoded Password", HIGH, "", PATTERN, r"""(password|passwd|pwd|secret|token)\s*=\s*'[^']+'"""),
    Rule("SEC-AUTH-005", "Excessive Privileges (GRANT ALL)", HIGH, "", NODE),
    Rule("SEC-AUTH-002", "Grant to PUBLIC Role", MEDIUM, "", PATTERN, r"""\bGRANT\b.+\bTO\s+PUBLIC\b"""),
    Rule("SEC-AUTH-003", "User Creation Without Password", HIGH, "", PATTERN, r"""\bCREATE\s+(USER|LOGIN)\b(?![\s\S]*(IDENTIFIED\s+BY|WITH\s+PASSWORD|PASSWORD\s*=))"""),
    Rule("SEC-AUTH-004", "Password Policy Bypass", MEDIUM, "", PATTERN, r"""\bCHECK_POLICY\s*=\s*OFF\b|\bCHECK_EXPIRATION\s*=\s*OFF\b"""),
    Rule("SEC-AUTHZ-001", "Privilege Escalation via Role Grant", HIGH, "", PATTERN, r"""\b(GRANT|ALTER\s+ROLE|sp_addrolemember|ALTER\s+USER)\b[^;]+\b(admin|administrator|superuser|sysadmin|db_owner|dba|root|securityadmin|serveradmin|dbcreator|sa)\b"""),
    Rule("SEC-AUTHZ-002", "Schema Ownership Change", HIGH, "", PATTERN, r"""\b(ALTER\s+AUTHORIZATION\s+ON|ALTER\s+SCHEMA\s+\w+\s+TRANSFER|CHOWN|SET\s+OWNER)\b"""),
    Rule("SEC-AUTHZ-003", "Horizontal Authorization Bypass", HIGH, "", NODE),
    Rule("SEC-CMD-001", "OS Command Injection (SQL Server)", CRITICAL, "tsql", PATTERN, r"""\b(xp_cmdshell|sp_OACreate|sp_OAMethod|EXEC\s+master\.\.xp_cmdshell)\b"""),
    Rule("SEC-CMD-001-PG", "OS Command Injection (PostgreSQL)", CRITICAL, "postgresql", PATTERN, r"""\b(pg_read_file|pg_execute_server_program|pg_ls_dir|pg_read_binary_file|FROM\s+PROGRAM|libc\.so)\b"""),
    Rule("SEC-PATH-001", "Path Traversal in File Operations", HIGH, "", PATTERN, r"""\b(OPENROWSET|BULK\s+INSERT|LOAD_FILE|INTO\s+OUTFILE|UTL_FILE|BFILE|DBMS_LOB\.LOADFROMFILE)\b[^;]*(\+|CONCAT|\|\|)[^;]*[\'"][^\'"]*\.\.[/\\]"""),
    Rule("SEC-PATH-002", "Local File Inclusion", HIGH, "", PATTERN, r"""\b(EXECUTE|EXEC|SOURCE|\\i|@)\b[^;]*(\+|CONCAT|\|\|)[^;]*\.sql\b"""),
    Rule("SEC-SSRF-001", "Server-Side Request Forgery via Database", HIGH, "", PATTERN, r"""\b(sp_OACreate.*XMLHTTP|UTL_HTTP|DBMS_NETWORK|HTTPURLConnection|CURL)\b|\bOPENROWSET\b.*[\'"][^\'"]*(?:http|https|ftp|ldap|\\\\)"""),
    Rule("SEC-ORA-001", "Oracle UTL Package Access", HIGH, "oracle", PATTERN, r"""\bUTL_(?:HTTP|FILE|SMTP|TCP|INADDR)\b"""),
    Rule("SEC-TSQL-001", "OPENROWSET / OPENDATASOURCE Usage", HIGH, "tsql", PATTERN, r"""\b(?:OPENROWSET|OPENDATASOURCE)\s*\("""),
    Rule("SEC-TSQL-002", "OLE Automation (sp_OACreate)", CRITICAL, "tsql", PATTERN, r"""\bsp_OA(?:Create|Method|GetProperty|SetProperty|Destroy)\b"""),
    Rule("SEC-CH-001", "ClickHouse url() Table Function", HIGH, "clickhouse", PATTERN, r"""\burl\s*\(\s*['\"]https?://"""),
    Rule("SEC-CFG-001", "Dangerous Server Configuration", HIGH, "tsql", PATTERN, r"""\bsp_configure\b.+\bxp_cmdshell\b|\bsp_configure\b.+\bOle\s+Automation\b|\bsp_configure\b.+\bclr\s+enabled\b|\bsp_configure\b.+\bAd\s+Hoc\s+Distributed\s+Queries\b"""),
    Rule("SEC-PRIV-001", "Overprivileged Execution Context", MEDIUM, "", PATTERN, r"""\bEXECUTE\s+AS\s+(USER\s*=\s*)?'(dbo|sa|sysadmin)'|\bEXECUTE\s+AS\s+LOGIN\s*=\s*'(sa|sysadmin)'|\bEXECUTE\s+AS\s+(OWNER|SELF)\b|\bSECURITY\s+DEFINER\b|\bWITH\s+ADMIN\s+OPTION\b|\bWITH\s+GRANT\s+OPTION\b"""),
    Rule("SEC-CONFIG-001", "Hardcoded Database Credentials", CRITICAL, "", PATTERN, r"""(PASSWORD\s*=\s*[\'"][^\'"]{4,}[\'"]|pwd\s*=\s*[\'"][^\'"]{4,}[\'"]|IDENTIFIED\s+BY\s+[\'"][^\'"]+[\'"])"""),
    Rule("SEC-CONFIG-002", "Weak SSL/TLS Configuration", HIGH, "", PATTERN, r"""(Encrypt\s*=\s*(false|no|0)|TrustServerCertificate\s*=\s*true|sslmode\s*=\s*(disable|allow|prefer)|ssl\s*=\s*(false|0))"""),
    Rule("SEC-CONFIG-003", "Default Credential Usage", HIGH, "", PATTERN, r"""\b(sa|admin|root|postgres|mysql)\b.*\b(Password\s*=\s*[\'"]?(sa|admin|root|password|123456|default)[\'"]?|IDENTIFIED\s+BY\s+[\'"]?(sa|admin|root|password)[\'"]?)"""),
    Rule("SEC-CONFIG-004", "Overly Permissive CORS/Access", MEDIUM, "", PATTERN, r"""(GRANT\s+.*\s+TO\s+.*@[\'"]%[\'"]|CREATE\s+USER\s+.*@[\'"]%[\'"]|Host\s*=\s*[\'"]?(\*|0\.0\.0\.0|%|::|all)[\'"]?)"""),
    Rule("SEC-PG-002", "Search Path Manipulation", HIGH, "postgresql", PATTERN, r"""\bSET\s+search_path\b"""),
    Rule("SEC-PG-004", "SECURITY DEFINER Without search_path", HIGH, "postgresql", PATTERN, r"""\bSECURITY\s+DEFINER\b(?![\s\S]*\bsearch_path\b)"""),
    Rule("SEC-CRYPTO-001", "Weak Hashing Algorithm", HIGH, "", PATTERN, r"""\b(MD5|SHA1|SHA)\s*\(\s*[^)]*\b(password|passwd|pwd|secret|token|key|credential)\b"""),
    Rule("SEC-CRYPTO-002", "Plaintext Password in Query", HIGH, "", PATTERN, r"""\b(INSERT\s+INTO|UPDATE)\b[^;]*\b(password|passwd|pwd|secret_key|api_key|auth_token)\b[^;]*?(?:=\s*|VALUES\s*\()[^;(]*?['\"][^'\"()]{4,}['\"]"""),
    Rule("SEC-CRYPTO-003", "Hardcoded Encryption Key", HIGH, "", PATTERN, r"""\b(AES_ENCRYPT|AES_DECRYPT|ENCRYPT|DECRYPT|ENCRYPTBYKEY|DECRYPTBYKEY|HASHBYTES|HMAC)\s*\([^)]*,\s*['\"][A-Za-z0-9\+/=!@#\$%^&\*\-]{8,}['\"]"""),
    Rule("SEC-CRYPTO-004", "Weak Encryption Algorithm", MEDIUM, "", PATTERN, r"""\b(DES_ENCRYPT|DES_DECRYPT|TRIPLE_DES|3DES|RC4|RC2|BLOWFISH|IDEA)\s*\("""),
    Rule("SEC-DATA-001", "Data Exfiltration via File Operations", HIGH, "", PATTERN, r"""\bINTO\s+OUTFILE\b|\bINTO\s+DUMPFILE\b|\bLOAD_FILE\s*\(|\bLOAD\s+DATA\s+INFILE\b|\bBULK\s+INSERT\b|\bCOPY\b.+\bFROM\s+PROGRAM\b|\bCOPY\b.+\bTO\s+PROGRAM\b"""),
    Rule("SEC-DATA-002", "Remote/Linked Data Access", HIGH, "", PATTERN, r"""\bOPENROWSET\s*\(|\bOPENDATASOURCE\s*\(|\bOPENQUERY\s*\(|\bdblink_connect\s*\(|\bdblink_exec\s*\(|\bdblink\s*\("""),
    Rule("SEC-MYSQL-001", "LOAD DATA LOCAL INFILE", CRITICAL, "mysql", PATTERN, r"""\bLOAD\s+DATA\s+LOCAL\s+INFILE\b"""),
    Rule("SEC-RS-001", "COPY With Embedded Credentials", CRITICAL, "redshift", PATTERN, r"""\bCOPY\b.*\b(?:ACCESS_KEY_ID|SECRET_ACCESS_KEY|CREDENTIALS)\b"""),
    Rule("SEC-SF-001", "COPY INTO With Embedded Credentials", CRITICAL, "snowflake", PATTERN, r"""\bCOPY\s+INTO\b.*\b(?:AWS_KEY_ID|AWS_SECRET_KEY|AZURE_SAS_TOKEN|CREDENTIALS)\b"""),
    Rule("SEC-SF-002", "CLONE Without COPY GRANTS", MEDIUM, "snowflake", PATTERN, r"""\bCLONE\b(?!.*\bCOPY\s+GRANTS\b)"""),
    Rule("SEC-DOS-001", "Unbounded Recursive CTE", HIGH, "", NODE),
    Rule("SEC-DOS-002", "Regex Denial of Service (ReDoS)", MEDIUM, "", PATTERN, r"""\b(REGEXP|RLIKE|REGEXP_LIKE|REGEXP_MATCHES|SIMILAR\s+TO)\s*\(?[^)]*(\(\?\:?\[?\w+\]\*\)[\*\+]|\(\.\*\)[\*\+]|\(\w\+\)[\*\+]|\[\^?\w+\]\*\[\^?\w+\]\*)"""),
    Rule("SEC-PG-001", "pg_sleep Usage Detected", MEDIUM, "postgresql", PATTERN, r"""\bpg_sleep\s*\("""),
    Rule("PERF-TSQL-004", "WAITFOR DELAY in Production Code", MEDIUM, "tsql", PATTERN, r"""\bWAITFOR\s+DELAY\b"""),
    Rule("SEC-INFO-001", "Database Version Disclosure", LOW, "", PATTERN, r"""(?:@@VERSION|VERSION\(\)|SERVERPROPERTY\(\'ProductVersion\'\)|pg_version\(\)|BANNER|v\$version)"""),
    Rule("SEC-INFO-002", "Schema Information Disclosure", MEDIUM, "", PATTERN, r"""\b(INFORMATION_SCHEMA|sys\.|pg_catalog|ALL_TABLES|USER_TABLES|DBA_TABLES|SHOW\s+TABLES|SHOW\s+COLUMNS|DESCRIBE|syscolumns|sysobjects)\b"""),
    Rule("SEC-INFO-003", "Timing Attack Pattern", MEDIUM, "", PATTERN, r"""\b(SLEEP|WAITFOR\s+DELAY|DBMS_LOCK\.SLEEP|PG_SLEEP)\b\s*\(\s*\d+\s*\)"""),
    Rule("SEC-INFO-004", "Verbose Error Messages", MEDIUM, "", PATTERN, r"""\b(RAISERROR|THROW|SIGNAL)\b[^;]*\b(@@ERROR|ERROR_MESSAGE|SQLERRM|SQLSTATE)|\bCAST\s*\(\s*(?:@@VERSION|VERSION\(\)|BANNER)"""),
    Rule("SEC-INJ-001", "Potential SQL Injection", CRITICAL, "", PATTERN, r"""(['\"]\s*\+\s*[a-zA-Z_]\w*)|([a-zA-Z_]\w*\s*\+\s*['\"])"""),
    Rule("SEC-INJ-002", "Dynamic SQL Execution", HIGH, "", PATTERN, r"""EXEC\s*\(|EXECUTE\s*\(|EXECUTE\s+IMMEDIATE\b|\bsp_executesql\b|\bPREPARE\s+\w+\s+FROM\s+@|\bPREPARE\s+\w+\s+FROM\s+CONCAT\s*\("""),
    Rule("SEC-INJ-003", "Tautological OR Condition", MEDIUM, "", PATTERN, r"""\bOR\s+1\s*=\s*1\b|\bOR\s+'[^']*'\s*=\s*'[^']*'|\bOR\s+\"[^\"]*\"\s*=\s*\"[^\"]*\"|\bOR\s+TRUE\b"""),
    Rule("SEC-INJ-004", "Time-Based Blind Injection Indicator", HIGH, "", PATTERN, r"""\bWAITFOR\s+DELAY\b|\bSLEEP\s*\(|\bpg_sleep\s*\(|\bBENCHMARK\s*\("""),
    Rule("SEC-INJ-005", "Second-Order SQL Injection Risk", HIGH, "", NODE),
    Rule("SEC-INJ-006", "LIKE Clause Wildcard Injection", MEDIUM, "", NODE),
    Rule("SEC-INJ-007", "LDAP Injection in Directory Queries", HIGH, "", PATTERN, r"""\b(LDAP|AD_|DIRECTORY)\w*\s*\([^)]*(\+|CONCAT|CONCATENATE|\|\|)[^)]*\b(cn=|ou=|dc=|uid=|objectClass=)\b"""),
    Rule("SEC-INJ-008", "NoSQL Injection Pattern", HIGH, "", PATTERN, r"""\b(OPENJSON|JSON_QUERY|JSON_VALUE|FOR\s+JSON|MONGODB|COSMOSDB|mongo_\w*|json_\w*)\b[^;]*(\+|CONCAT|\|\|)[^;]*[{}\[\]$]"""),
    Rule("SEC-INJ-009", "XML/XPath Injection", HIGH, "", PATTERN, r"""\b(XMLQUERY|XMLEXISTS|XPATH|XQUERY|xml_)\b[^;]*(\+|CONCAT|\|\|)[^;]*[/\[\]]"""),
    Rule("SEC-INJ-010", "Server-Side Template Injection", HIGH, "", PATTERN, r"""\b(RENDER|TEMPLATE|EVAL|EXECUTE|PROCESS|render_)\w*\b\([^)]*(\+|CONCAT|\|\|)"""),
    Rule("SEC-INJ-011", "SQL Injection via JSON Functions", HIGH, "", PATTERN, r"""\b(JSON_OBJECT|JSON_ARRAY|JSON_INSERT|JSON_REPLACE|JSON_SET|json_\w*)\b[^;]*(\+|CONCAT|\|\|)"""),
    Rule("SEC-PG-003", "RAISE NOTICE Log Injection", MEDIUM, "postgresql", PATTERN, r"""\bRAISE\s+(?:NOTICE|WARNING|INFO|LOG|DEBUG)\s+.*\|\|"""),
    Rule("SEC-ORA-002", "DBMS_SQL Dynamic Execution", HIGH, "oracle", PATTERN, r"""\bDBMS_SQL\s*\.\s*(?:PARSE|EXECUTE|OPEN_CURSOR)\b"""),
    Rule("SEC-ORA-003", "EXECUTE IMMEDIATE With Concatenation", CRITICAL, "oracle", PATTERN, r"""\bEXECUTE\s+IMMEDIATE\s+.*\|\|"""),
    Rule("SEC-LOG-001", "Sensitive Data in Error Output", MEDIUM, "", PATTERN, r"""\b(RAISERROR|THROW|RAISE|PRINT|DBMS_OUTPUT\.PUT_LINE|RAISE\s+NOTICE)\b[^;]*\b(password|pwd|ssn|social_security|credit_card|card_number|cvv|secret|token|api_key|private_key)\b"""),
    Rule("SEC-LOG-002", "Audit Trail Manipulation", HIGH, "", PATTERN, r"""\b(DELETE\s+FROM|TRUNCATE|UPDATE|DROP\s+TABLE)\s+[^;]*\b(audit|audit_log|audit_trail|event_log|security_log|access_log|change_log|history)\b|\b(SET\s+(?:sql_log_off|general_log|audit_trail|log_statement)\s*=\s*(?:0|OFF|NONE|false))\b"""),
    Rule("SEC-SESSION-001", "Insecure Session Token Storage", HIGH, "", PATTERN, r"""\b(INSERT\s+INTO|UPDATE)\b[^;]*\b(session_token|auth_token|access_token|refresh_token|bearer_token|jwt_token)\b[^;]*?(?:=\s*|VALUES\s*\()[^;(]*?['\"]?[A-Za-z0-9_\-\.]{20,}['\"]?"""),
    Rule("SEC-SESSION-002", "Session Timeout Not Enforced", MEDIUM, "", PATTERN, r"""\bSELECT\b[^;]*\bFROM\s+\w*(session|token)[s]?\b[^;]*\bWHERE\b(?!.*\b(expir|valid_until|expires_at|ttl|created_at)\b)"""),
    Rule("SEC-SQLITE-001", "ATTACH DATABASE Arbitrary File Access", HIGH, "sqlite", PATTERN, r"""\bATTACH\s+(?:DATABASE\s+)?(?:'[^']*'|\"[^\"]*\"|\S+)\s+AS\b"""),
]
# fmt: on
