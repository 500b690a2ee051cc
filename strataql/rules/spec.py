"""The shape of a rule."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

CRITICAL, HIGH, MEDIUM, LOW, INFO = "critical", "high", "medium", "low", "info"

#: Severities by falling weight.
SEVERITY_WEIGHT = {CRITICAL: 5, HIGH: 4, MEDIUM: 3, LOW: 2, INFO: 1}

#: How a rule detects: a pattern over the text, conditions over the text, the statement's structure, schemas.
PATTERN, TEXT, NODE, SCHEMA = "pattern", "text", "node", "schema"

#: The dimension of a rule id's first segment, and the rules filed elsewhere.
DIMENSION_OF = {"SEC": "security", "PERF": "performance", "REL": "reliability", "QUAL": "quality", "COST": "cost", "COMP": "compliance", "MIG": "migration", "SCH": "schema"}
FILED_ELSEWHERE = {"COST-SF-002": "reliability", "SCHEMA-COL-001": "reliability", "SCHEMA-TBL-001": "reliability", "SCHEMA-IDX-001": "performance"}


#: Word sets that are tested in front of one pattern, and words of one set.
MOST_SETS, MOST_WORDS = 5, 24


@lru_cache(maxsize=4096)
def needed_words(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of words: every match of a pattern, taken without case, holds at least one word of each set."""
    try:
        from re import _parser  # the standard library's own reading of the pattern

        found = _needed(_parser.parse(pattern, re.IGNORECASE))
    except (ImportError, re.error, AttributeError, TypeError):
        return ()
    # The sets whose shortest word is longest say most.
    best = sorted(set(found), key=lambda words: (-min(map(len, words)), len(words), sorted(words)))[:MOST_SETS]
    return tuple(tuple(sorted(words)) for words in best)


def _needed(parts) -> list[frozenset[str]]:
    """The word sets of a sequence of pattern parts, all of which must be met."""
    found: list[frozenset[str]] = []
    run = ""

    def end_run() -> None:
        nonlocal run
        if len(run) >= 2 or (run and not run.isalnum() and not run.isspace()):  # one letter says too little, one sign may do
            found.append(frozenset([run]))
        run = ""

    for op, arg in parts:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).upper()
            continue
        end_run()
        if name == "SUBPATTERN":
            found += _needed(arg[3])
        elif name == "BRANCH":
            branches = [_needed(branch) for branch in arg[1]]
            if all(branches):
                # One set of each branch, the one that says most, makes a set for all of them.
                together = frozenset().union(*(max(sets, key=lambda words: min(map(len, words))) for sets in branches))
                if len(together) <= MOST_WORDS:
                    found.append(together)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            found += _needed(arg[2])
    end_run()
    return found


@dataclass(frozen=True)
class Rule:
    """One rule; `dialects` is comma-separated, empty for all."""

    rule_id: str
    name: str
    severity: str
    dialects: str
    kind: str
    pattern: str = ""

    @property
    def dimension(self) -> str:
        return FILED_ELSEWHERE.get(self.rule_id) or DIMENSION_OF[self.rule_id.split("-")[0]]

    @property
    def category(self) -> str:
        return self.rule_id.split("-")[1].lower()

    @property
    def dialect_list(self) -> list[str]:
        return [d for d in self.dialects.split(",") if d]

    @property
    def java_pattern(self) -> str:
        """The pattern for java.util.regex: without case, and with the end of input spelt its way."""
        return "(?i)" + self.pattern.replace(r"\Z", r"\z")

    @property
    def needed(self) -> tuple[tuple[str, ...], ...]:
        """Sets of upper-case words; any match holds at least one of each."""
        return needed_words(self.pattern)

    @property
    def looks_around(self) -> bool:
        """Whether the pattern has lookaround or backreferences, which automata-based engines lack."""
        return bool(re.search(r"\(\?[=!]|\(\?<[=!]|\\[1-9]", self.pattern))
