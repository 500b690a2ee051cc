"""What a finding says, why it matters and what to do: texts by the topic of a rule (its id's second part).

Messages are made from the rule's name and what was found; impact and remedy come from the topic, or
from the rule's dimension where the topic has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataql.rules.spec import Rule

#: By dimension: (impact, remedy).
GENERAL = {
    "security": ("Data or the server may be read, changed or taken over by somebody who should not.", "Take away the unsafe construct, or limit who can reach it."),
    "performance": ("The statement does more work than its result needs, and more with every row.", "Let the statement touch fewer rows, or let an index find them."),
    "reliability": ("The statement can lose or damage data, or leave work half done.", "Bound what is changed, and make it safe to run again."),
    "compliance": ("Personal or regulated data is handled without what the rules for it ask.", "Record the purpose and consent, and keep access limited and logged."),
    "quality": ("The statement is harder to read, test and change than it needs to be.", "Write it in the plainer, standard form."),
    "cost": ("The statement reads, moves or keeps more than is paid for gladly.", "Read and keep less, and closer to where it is used."),
    "schema": ("Statements that rely on the object fail once the change is made.", "Change what reads the object first, or keep it until nothing does."),
    "migration": ("Whatever still relies on the object fails once the migration has run.", "Split the migration: stop using the object, then drop it."),
}

#: By prefix and topic: (impact, remedy), where there is more to say than for the dimension.
TOPICS = {
    "SEC-AUTH": ("Credentials in reach of readers, or accounts without any, let strangers in.", "Keep credentials in a secret store and grant only what a role needs."),
    "SEC-AUTHZ": ("A user may reach rows or rights that belong to somebody else.", "Filter by owner and grant by narrow roles."),
    "SEC-CMD": ("Code on the database server runs with the server's rights.", "Switch the feature off and run such jobs outside the database."),
    "SEC-PATH": ("A path put together from input can lead to any file of the server.", "Use fixed paths, or names from a list."),
    "SEC-SSRF": ("The server can be made to call addresses within its own network.", "Call services from the application, with a list of allowed hosts."),
    "SEC-CONFIG": ("Weak settings or default passwords open the connection or the server.", "Use encrypted connections, hosts by name and passwords from a secret store."),
    "SEC-CRYPTO": ("Weak or misplaced cryptography protects nothing once the data leaks.", "Hash passwords with a slow salted function; take keys from a key store."),
    "SEC-DATA": ("Data leaves or enters the database past its access control.", "Export and import through a reviewed job."),
    "SEC-DOS": ("One statement can keep the server busy for everybody.", "Bound recursion, patterns and waiting."),
    "SEC-INFO": ("Versions and catalogues tell an attacker where to begin.", "Answer errors without internals and limit catalogue access."),
    "SEC-INJ": ("Input becomes part of the statement and can change what it does.", "Bind parameters; take identifiers from a list."),
    "SEC-LOG": ("Secrets end up in logs, or traces of an attack are wiped out.", "Mask values before logging and keep logs where nobody can delete them."),
    "SEC-SESSION": ("A token that is stored or accepted as it is can be used by whoever reads it.", "Store a hash, check expiry and rotate."),
    "PERF-AGG": ("All rows are read and grouped, though a part would do.", "Filter before grouping, or keep a summary."),
    "PERF-BATCH": ("One large change holds locks and log space until it is done.", "Change rows in batches by key."),
    "PERF-CURSOR": ("Rows are handled one by one where sets would be.", "Write the loop as one statement."),
    "PERF-HINT": ("A hint stays when the data no longer fits it.", "Drop the hint and keep statistics fresh."),
    "PERF-IDX": ("No index can be used, so the table is scanned.", "Compare the bare column with a value of its type, or index the expression."),
    "PERF-JOIN": ("Intermediate results grow faster than the tables.", "Join on keys and drop what isn't needed."),
    "PERF-LOCK": ("Others wait, or read what is not committed.", "Keep transactions short and pick the isolation on purpose."),
    "PERF-MEM": ("The step has to be held or sorted in memory, or spills.", "Group by fewer values and send less on."),
    "PERF-NET": ("More columns and rows travel than are used.", "Name the columns and bound the rows."),
    "PERF-SCALAR": ("A function or query runs again for each row.", "Turn it into a join or an inline function."),
    "PERF-SCAN": ("The whole table is read or sent.", "Name columns, filter and limit."),
    "PERF-SORT": ("A sort without an index has to read everything first.", "Sort by an indexed column."),
    "REL-DATA": ("Rows or structures are gone for good.", "Add a filter, a backup and a way back."),
    "REL-DEAD": ("Two sessions can wait for each other.", "Touch tables and rows in one order and in small steps."),
    "REL-ERR": ("Errors vanish, and what follows works on wrong data.", "Handle the error or raise it again."),
    "REL-FK": ("Rows may refer to nothing.", "Declare the reference and state what happens on delete."),
    "REL-IDEM": ("A second run changes the data again.", "Guard the change by a key or a version."),
    "REL-RACE": ("Between check and change somebody else may act.", "Lock the row, or do both in one statement."),
    "REL-RETRY": ("A failed transaction is not tried again.", "Catch the failure and retry a bounded number of times."),
    "REL-STALE": ("What was just written may not be read yet.", "Read within the same transaction or from the primary."),
    "REL-TIMEOUT": ("Nothing stops the statement when it runs away.", "Set a timeout or bound the rows."),
    "REL-TXN": ("Work may stay open or be lost between statements.", "Begin and commit around exactly what belongs together."),
    "COMP-GDPR": ("Personal data is read, moved or deleted without the record that the law asks for.", "Check consent, log the access and follow the retention plan."),
    "COMP-CCPA": ("Data of people who opted out is shared.", "Filter by the opt-out flag."),
    "COMP-HIPAA": ("Health data is touched without an audit trail or with more columns than needed.", "Log the access and read only what is needed."),
    "COMP-PCI": ("Card data is stored or read beyond what is allowed.", "Store tokens, never verification codes, and bound by retention."),
    "COMP-SOX": ("Financial records change without a trace of who agreed.", "Name the change request and separate the duties."),
    "COMP-RET": ("Logs without a retention rule grow and keep data too long.", "Add a retention date or a purge job."),
    "COMP-AUD": ("Audit records can be changed.", "Make audit tables append-only."),
    "QUAL-COMPLEX": ("Few will dare to change the statement.", "Split it into named parts."),
    "QUAL-DEAD": ("Unused code is maintained and misread.", "Remove it, or keep one copy."),
    "QUAL-DEBT": ("Work that was put off is still there.", "Do it or file it."),
    "QUAL-DOC": ("Readers have to guess what is meant.", "Add a comment that says why."),
    "QUAL-MODERN": ("Old forms hide joins and cases that are left out.", "Use explicit joins, parameters and ELSE."),
    "QUAL-NAME": ("Names mislead or need quoting.", "Use plain, whole words."),
    "QUAL-NULL": ("The comparison is never true.", "Use IS NULL or IS NOT NULL."),
    "QUAL-SCHEMA": ("The table accepts rows that it should not.", "Declare keys, references and exact types."),
    "QUAL-STYLE": ("The form says something other than what is meant.", "Use the usual form."),
    "QUAL-TEST": ("The same test can give different results.", "Fix order, time and data in tests."),
    "COST-COMPUTE": ("The warehouse computes over all rows each time.", "Filter, partition or keep the result."),
    "COST-CROSS": ("Data crosses regions or servers at a price.", "Join where the data is, or copy once."),
    "COST-IDX": ("Indexes are kept and written that reads don't need, or are missing where they would pay.", "Keep the indexes that queries use."),
    "COST-PAGE": ("Pages are counted or skipped by reading them.", "Page by key."),
    "COST-STORAGE": ("A copy of all columns is kept and paid for.", "Keep the columns that are used."),
    "SCHEMA-TBL": ("The statement fails when it runs.", "Correct the name or create the table."),
    "SCHEMA-COL": ("The statement fails when it runs.", "Correct the name or add the column."),
    "SCHEMA-IDX": ("Each run reads the whole table.", "Create the index."),
}


def impact(rule: Rule) -> str:
    return _texts(rule)[0]


def remedy(rule: Rule) -> str:
    return _texts(rule)[1]


def _texts(rule: Rule) -> tuple[str, str]:
    return TOPICS.get("-".join(rule.rule_id.split("-")[:2])) or GENERAL.get(rule.dimension, GENERAL["quality"])


#: Characters of a snippet that a message quotes.
QUOTED = 80


def message(name: Column, snippet: Column) -> Column:
    """The rule's name and the first line of what was found."""
    line = F.trim(F.substring_index(F.regexp_replace(F.trim(snippet), "\r", "\n"), "\n", 1))
    short = F.when(F.length(line) > QUOTED, F.concat(F.substring(line, 1, QUOTED), F.lit("..."))).otherwise(line)
    return F.when(F.length(short) > 0, F.concat(name, F.lit(": "), short)).otherwise(name)


def explain(rule: Rule) -> dict[str, str]:
    """All that is known of a rule, for people."""
    return {
        "rule_id": rule.rule_id, "name": rule.name, "severity": rule.severity, "dimension": rule.dimension, "category": rule.category,
        "dialects": rule.dialects or "all", "kind": rule.kind, "pattern": rule.pattern, "impact": impact(rule), "remedy": remedy(rule),
    }
