"""Credentials embedded in SQL and configuration text: found lexically and masked in place.

The text is cut into tokens; a literal counts when it is assigned or passed to a credential-named
identifier and is no placeholder. Credentials that need no name (issuer formats, private key
blocks, URL user info, authorization headers) are found wherever they stand, and words for
passwords within comments and literals are followed to the value behind them. Masking replaces the
characters of the secret alone: delimiters, escapes and line ends stay.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Formats by which issuers make their keys recognisable.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}"
    r"|glpat-[A-Za-z0-9_-]{20}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,}"
    r"|AIza[A-Za-z0-9_-]{35}"
    r"|npm_[A-Za-z0-9]{36}"
    r"|SG\.[A-Za-z0-9_-]{20,24}\.[A-Za-z0-9_-]{40,46}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{20,}"
    r")(?![A-Za-z0-9_])"
)
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?P<body>(?:[^-]|-(?!----))+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]+://[^\s:/@'\"<>]*:(?P<value>(?:(?!://)[^\s'\"])+?)@[\w\[]")
HEADER = re.compile(r"(?i)\b(?P<scheme>bearer|basic)\s+(?P<value>[A-Za-z0-9+/=_.~-]{8,})")
#: Within literals and comments: name=value, name: value.
PAIR = re.compile(r"(?<![\w.])(?<![\w.]-)(?P<name>\w[\w.-]*)\"?\s*(?P<sign>[=:])\s*\"?(?P<value>[^\s;,&'\"]+)")
#: Words in front of a value in prose.
SPOKEN = re.compile(r"(?i)\b(?:password|passwd|pwd|pw|pass|passphrase)\s+(?P<value>\S+)")

NAMED = re.compile(
    r"(?:^|[\W_])(?:pass(?:word|wd|[_-]?phrase|code)?|passwd|pwd|pw|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|secret[_-]?keys?|private[_-]?keys?|account[_-]?keys?|credentials?|signature|sig|auth[_-]?keys?|encryption[_-]?keys?)$",
    re.IGNORECASE,
)
#: Names whose literals may be phrases of several words.
PHRASED = re.compile(r"(?:^|[\W_])(?:pass(?:word|wd|[_-]?phrase|code)?|passwd|pwd|pw|identified)$", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
PLACEHOLDER = re.compile(
    r"""^(?:
      \W* | \{.*\}? | \$\{?.* | %.*%? | :\w+ | @\w+ | <.*>? | \[.*\] | \?+
      | [xX*\#.•-]{3,} | (?:x+|X+|\*+)
      | (?i:redacted|masked|hidden|removed|none|null|nil|empty|true|false|todo|tbd|unset|set[-_ ]?me|change[-_ ]?me.*|your[-_ ].*|my[-_ ]?(?:password|secret|token)|example.*|placeholder.*|dummy.*|password|passwd|secret|token|api[-_]?key)
      | (?i:enc|vault|env|ssm|arn|kms|secretsmanager|file|op|ref|keyvault|aws|gcp|azure)[\[:(/].*
      | (?i:os\.environ|getenv|process\.env|vault|secrets?)\W.*
    )$""",
    re.VERBOSE | re.DOTALL,
)
DIGEST = re.compile(r"^(?:\$2[abxy]?\$.*|\$(?:1|5|6|argon2\w*|scrypt|pbkdf2[\w-]*)\$.*|md5[0-9a-fA-F]{32}|SCRAM-SHA-256\$.*|\*[0-9A-F]{40}|\{?S?SHA\d*\}?[:$].*|\{S?(?:SHA|MD5)\d*\}.*|sha(?:1|256|512)[:-].*|S:[0-9A-F]{20,}.*)$", re.DOTALL)

#: Calls that look a secret up by its name or make a new one: their literals are no secrets.
LOOKUP = re.compile(
    r"(?:^|[\W_])(?:get|read|fetch|load|lookup|find|access|resolve|env|getenv|environ|environment|variable|vault|settings?|config|parameter|kms|ssm|secretsmanager|secret_?manager|keyvault|generate|gen|random|rand|new|rotate|list|count)(?:$|[\W_])|^secrets?$",
    re.IGNORECASE,
)
SETTER = re.compile(r"(?:^|[\W_])(?:set|create|put|store|add|update|save|change|alter|reset|write)(?:$|[\W_])", re.IGNORECASE)
#: Calls whose literals are patterns, formats or paths.
SHAPING = re.compile(r"^(?:regexp?_\w+|replace|translate|substr\w*|split\w*|strpos|instr|charindex|position|to_char|to_date|to_timestamp|date_\w+|strftime|format|json_(?:value|query|extract\w*)|get_json_object|nextval|cast|convert|if|iif|nullif|decode)$", re.IGNORECASE)
#: What encryption, hashing and encoding are told besides the secret.
ALGORITHM = re.compile(r"(?i)(?:hmac[-_]?)?(?:sha[-_]?\d.*|md[245]|(?:aes|des|3des|rc4)\b.*|base64\w*|hex|escape|bcrypt|bf|xdes|blowfish|scrypt|pbkdf2.*|argon2.*|utf-?\d+\w*|ascii|latin-?1|(?:cipher|compress|s2k)-\S+=.*)")
#: In front of a name with a bracket: it is a table or column, not a call.
_DEFINES = frozenset("table into exists view index on references update from join key constraint unique type domain secret trigger with as only".split())
#: Words before a bracket that are no calls.
_NO_CALL = frozenset("in values and or not any all some exists select from where on using check set when then else case by over returning".split())

#: A cheap test that holds for every text in which anything below can be found; the same in Java.
MAY_HOLD = r"(?i)pass|pwd|pw(?![a-z0-9_])|secret|token|key|credential|identified|signature|sig(?![a-z0-9_])|bearer|basic|://|akia|asia|gh[pousr]_|github_pat_|glpat|xox[abprs]-|[sr]k_(?:live|test)_|aiza|npm_|sg\.|eyj"

_TOKEN = re.compile(
    r"(?P<comment>--[^\r\n]*|/\*.*?(?:\*/|\Z)|\#[^\r\n]*)"
    r"|(?P<literal>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")"
    r"|(?P<open>['\"])"
    r"|(?P<word>[A-Za-z_@$][\w$.-]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|:=|==|\S)",
    re.DOTALL,
)


@dataclass(frozen=True)
class Secret:
    """One secret of a text: what gave it away, and where its characters are."""

    kind: str
    start: int
    end: int


def is_named(name: str) -> bool:
    """Whether an identifier names a credential itself, not one of its properties."""
    if NAMED.search(name):
        return True
    return bool(NAMED.search(CAMEL.sub("_", name)))


def is_placeholder(value: str) -> bool:
    return bool(PLACEHOLDER.match(value)) or bool(DIGEST.match(value))


def is_strong(value: str) -> bool:
    """Whether a bare word in prose looks like a password rather than like language."""
    if len(value) < 6 or is_placeholder(value):
        return False
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    marks = sum(not c.isalnum() and c not in "-_.'" for c in value)
    if letters and digits:
        return not re.fullmatch(r"v?\d+(?:\.\d+)*|\d+[A-Za-z]{1,3}", value)
    if re.fullmatch(r"[A-Za-z]+(?:-[A-Za-z]+){2,}", value):
        return True
    mixed = bool(re.search(r"[a-z]", value) and re.search(r"(?<!^)[A-Z]", value))
    if letters and marks and len(value) >= 8:
        return True
    return mixed and len(value) >= 8


def _within(text: str, at: int, found: list[Secret], prose: bool) -> None:
    """Secrets named inside a comment or a literal that begins at `at` of the whole text."""
    for m in PAIR.finditer(text):
        value = m["value"].rstrip(")")
        if prose:
            value = re.sub(r"\*/$", "", value)
        if is_named(m["name"]) and len(value) >= 6 and not is_placeholder(value):
            strict = m["sign"] == ":" or prose and not _is_written_out(text, m, value)
            if not strict or is_strong(value):
                found.append(Secret("pair", at + m.start("value"), at + m.start("value") + len(value)))
    if prose:
        for m in SPOKEN.finditer(text):
            value = re.sub(r"(?:\*/)?[;,.]*$", "", m["value"])
            if is_strong(value):
                found.append(Secret("spoken", at + m.start("value"), at + m.start("value") + len(value)))


_REST = re.compile(r"[^\n]*?\w")


def _is_written_out(text: str, m: re.Match, value: str) -> bool:
    """Whether name=value in a comment gives a value, not a column, a call or, after a blank, a sentence."""
    if is_named(value) or re.match(r"[A-Za-z_][\w.]*\(", value):
        return False
    return m.end("sign") == m.start("value") or not _REST.match(text, m.end("value"))


def _usable(value: str, name: str = "") -> bool:
    """Whether a literal can be a secret; one of three words or more only under a password's name."""
    if len(value.strip()) < 4 or is_placeholder(value.strip()):
        return False
    return not re.search(r"\s\S+\s", value) or _is_phrased(name)


def _is_phrased(name: str) -> bool:
    name = name.strip("\"`[]' ")
    return bool(PHRASED.search(name) or PHRASED.search(CAMEL.sub("_", name)))


def find(text: str | None) -> list[Secret]:
    """The secrets of a text, in order, never overlapping. Null and empty texts have none."""
    if not text:
        return []
    found: list[Secret] = []
    for m in ISSUED.finditer(text):
        found.append(Secret("issued", *m.span()))
    for m in PRIVATE_KEY.finditer(text):
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", m["body"])) >= 40:
            found.append(Secret("private_key", *m.span("body")))
    for m in URL.finditer(text):
        if not is_placeholder(m["value"]) and len(m["value"]) >= 3:
            found.append(Secret("url", *m.span("value")))
    for m in HEADER.finditer(text):
        value = m["value"]
        if m["scheme"].lower() == "basic":
            try:
                plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue
            user, sign, word = plain.partition(b":")
            if not sign or len(word) < 4 or is_placeholder(word.decode("latin-1")):
                continue
        elif len(value) < 16 or not is_strong(value):
            continue
        found.append(Secret("header", *m.span("value")))
    _lexical(text, found)
    return _merged(found)


class _Tokens:
    """The tokens of a text, with what every bracket and place is assigned or passed to, told in one forward pass.

    What stands at a place is decided by earlier places alone, so each is worked out once, whatever
    the length of a list, the number of concatenated parts or the depth of calls.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(text)]
        self.words = [t[1].lower() for t in self.tokens]
        n = len(self.tokens)
        #: The open bracket around each place (itself for an open bracket), -1 outside; and where each closes.
        self.around, self.close = [-1] * n, {}
        self.literals = [k for k, t in enumerate(self.tokens) if t[0] == "literal"]
        open_now: list[int] = []
        for k, w in enumerate(self.words):
            if w == "(":
                open_now.append(k)
            elif w == ")" and open_now:
                self.close[open_now.pop()] = k
            self.around[k] = open_now[-1] if open_now else -1
        self.attach = self.words.index("attach") if "attach" in self.words else n
        self.receivers: list[str] = []
        self.carriers: dict[int, set[int]] = {}
        self.joined: dict[int, bool] = {}
        for k in range(n):
            self.receivers.append(self._receiver(k))

    def receiver(self, k: int) -> str:
        """What a literal behind place k is assigned or passed to: its name where that names a credential."""
        return self.receivers[k] if k >= 0 else ""

    def before(self, k: int) -> int:
        """The place before the literal at k, its prefix (N, E, ...) left out."""
        if k and self.words[k - 1] in ("n", "e", "r", "b", "q") and self.tokens[k - 1][2] + 1 == self.tokens[k][2]:
            return k - 2
        return k - 1

    def within(self, o: int) -> list[int]:
        """The literals within the bracket that opens at o."""
        return self.literals[bisect_left(self.literals, o) : bisect_left(self.literals, self.close.get(o, len(self.tokens)))]

    def _receiver(self, k: int) -> str:
        tokens, words = self.tokens, self.words
        kind, token, _ = tokens[k]
        if kind == "word":
            if words[k] == "by":
                return "identified" if k and words[k - 1] == "identified" else ""
            if words[k] == "key" and self.attach < k:
                return token
            return token if is_named(token) else ""
        if token in ("=", ":", "=>", ":="):
            k -= 1
            if k < 0:
                return ""
            kind, token, _ = tokens[k]
            if kind == "word":
                return token if is_named(token) else ""
            if kind == "literal":
                if is_named(token[1:-1]):
                    return token
                # SET PASSWORD FOR 'user'@'host' = '...'
                j = k
                while j >= 0 and (tokens[j][0] == "literal" or words[j] in ("@", "for", "user")):
                    j -= 1
                return tokens[j][1] if j >= 0 and j < k and words[j] == "password" and "for" in words[j:k] else ""
            return ""
        if token == ",":
            if k and tokens[k - 1][0] == "literal" and is_named(tokens[k - 1][1][1:-1].strip()):
                return tokens[k - 1][1]
            return self._in_call(k)
        if token == "(":
            return self._in_call(k)
        if token in ("+", "||", "|"):
            j = k - (1 if token != "|" else 2)
            return "call" if j >= 0 and tokens[j][0] == "literal" and self.receiver(self.before(j)) else ""
        return ""

    def _in_call(self, k: int) -> str:
        """Literals of a call that is named for a credential, or is itself assigned or passed to one.

        "call" for the parts of CONCAT(...), which count together; "named:" and the name for a call
        with a credential name; "passed:" and the receiver's name for any other call. Lookups and patterns carry no secret.
        """
        tokens, words, j = self.tokens, self.words, self.around[k]
        if j < 1:
            return ""
        name = words[j - 1]
        if tokens[j - 1][0] != "word" or name in _NO_CALL:
            return _passed(self.receiver(j - 1)) if words[j - 1] in ("=", ":=", "=>") else ""
        if name in ("concat", "concat_ws") and self.receiver(j - 2):
            if j not in self.joined:
                self.joined[j] = j in self.close and _usable("".join(tokens[i][1][1:-1] for i in self.within(j)))
            return "call" if self.joined[j] else ""
        if _is_opaque(tokens[j - 1][1]):
            return ""
        defined = j > 1 and words[j - 2] in _DEFINES
        if is_named(name) or is_named(tokens[j - 1][1]):
            return "" if defined else self._of_named(j, k + 1)
        if defined or j < 2 or words[j - 2] not in ("=", ":", "=>", ":=", ",", "(", "+", "||", "|"):
            return ""
        return _passed(self.receiver(j - 2))

    def _of_named(self, o: int, at: int) -> str:
        """Of several literals (a secret's name beside it) the strong ones and placeholders stand for the value, else the last."""
        if o not in self.carriers:
            own = [i for i in self.within(o) if not ALGORITHM.fullmatch(self.tokens[i][1][1:-1])]
            self.carriers[o] = set([i for i in own if is_strong(v := self.tokens[i][1][1:-1]) or is_placeholder(v)] or own[-1:])
        return f"named:{self.words[o - 1]}" if at in self.carriers[o] or at + 1 in self.carriers[o] else ""


def _lexical(text: str, found: list[Secret]) -> None:
    t = _Tokens(text)
    tokens, words = t.tokens, t.words
    for k, (kind, token, at) in enumerate(tokens):
        if kind == "comment":
            _within(token, at, found, prose=True)
            continue
        if kind == "word" and text.startswith("=", at + len(token)) and is_named(token):
            m = _BARE_VALUE.match(text, at + len(token) + 1)
            if m and len(m[0]) >= 8 and is_strong(m[0].rstrip(")")):
                found.append(Secret("pair", m.start(), m.start() + len(m[0].rstrip(")"))))
        if kind != "literal":
            continue
        inner = token[1:-1]
        before = t.before(k)
        named = t.receiver(before)
        if named.startswith(("passed:", "named:")):
            if (token[0] == "'" or named.startswith("named:")) and _usable(inner, named.rpartition(":")[2]) and not ALGORITHM.fullmatch(inner.strip()):
                found.append(Secret("assigned", at + 1, at + len(token) - 1))
            else:
                _within(inner, at + 1, found, prose=False)
        elif named == "call":
            found.append(Secret("assigned", at + 1, at + len(token) - 1))
        elif named and (token[0] == "'" or words[before] in ("by", ":", "=", "password")) and _usable(inner, named):
            if any(m["sign"] == "=" and is_named(m["name"]) for m in PAIR.finditer(inner)):
                _within(inner, at + 1, found, prose=False)  # name=value parts inside: only their values are the secret
            else:
                found.append(Secret("assigned", at + 1, at + len(token) - 1))
        else:
            _within(inner, at + 1, found, prose=False)
    _columns(t, found)


_BARE_VALUE = re.compile(r"[^\s'\";,&]+")


def _passed(name: str) -> str:
    return name and f"passed:{name.rpartition(':')[2]}"


def _is_opaque(name: str) -> bool:
    """Whether a called name looks a secret up, makes a new one, or takes patterns."""
    plain = CAMEL.sub("_", name)
    return bool(SHAPING.match(name) or (LOOKUP.search(plain) and not SETTER.search(plain)))


def _columns(t: _Tokens, found: list[Secret]) -> None:
    """INSERT INTO t (user, password) VALUES ('a', '...'): literals by their column's name."""
    tokens, words = t.tokens, t.words
    if "insert" not in words or "values" not in words:
        return
    v = words.index("values")
    try:
        o = words.index("(", words.index("insert"))
    except ValueError:
        return
    if o > v:
        return
    names = [""]
    for k in range(o + 1, v):
        if words[k] == ")":
            break
        if words[k] == ",":
            names.append("")
        else:
            names[-1] = tokens[k][1].strip("\"`[]'")
    wanted = {i: name for i, name in enumerate(names) if is_named(name)}
    if not wanted:
        return
    column = 0
    carries: list[bool] = []  # for every bracket open now, whether its literals reach the row as secrets
    for k in range(v + 1, len(tokens)):
        w = words[k]
        if w == "(":
            if not carries:
                column = 0
                carries.append(True)
            else:
                shaped = tokens[k - 1][0] == "word" and (words[k - 1] in _NO_CALL or _is_opaque(tokens[k - 1][1]))
                carries.append(carries[-1] and not shaped)
        elif w == ")":
            if carries:
                carries.pop()
        elif w == "," and len(carries) == 1:
            column += 1
        elif carries and column in wanted and tokens[k][0] == "literal" and _usable(tokens[k][1][1:-1], wanted[column]):
            inner = len(carries) > 1
            if not inner or tokens[k][1][0] == "'" and carries[-1] and not ALGORITHM.fullmatch(tokens[k][1][1:-1].strip()):
                found.append(Secret("column", tokens[k][2] + 1, tokens[k][2] + len(tokens[k][1]) - 1))


def _merged(found: list[Secret]) -> list[Secret]:
    out: list[Secret] = []
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if out and s.start < out[-1].end:
            if s.end > out[-1].end:
                out[-1] = Secret(out[-1].kind, out[-1].start, s.end)
            continue
        out.append(s)
    return out


_KEEP = re.compile(r"\\.|''|\"\"|[\r\n]+", re.DOTALL)


def redact(text: str | None) -> str | None:
    """The text with the characters of its secrets replaced by asterisks; escapes and line ends stay."""
    if not text:
        return text
    out, at = [], 0
    for s in find(text):
        out.append(text[at : s.start])
        i = s.start
        for m in _KEEP.finditer(text, s.start, s.end):
            out.append("*" * (m.start() - i))
            out.append(m.group())
            i = m.end()
        out.append("*" * (s.end - i))
        at = s.end
    out.append(text[at:])
    return "".join(out)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, k, s.kind, s.start, s.end - s.start) for i, t in zip(pdf["id"], pdf["text"]) for k, s in enumerate(find(t))]
        yield pd.DataFrame(rows, columns=["id", "ordinal", "kind", "start", "length"])


def _mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "text": [redact(t) for t in pdf["text"]]})


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ordinal, kind, start, length of every secret; the secrets themselves are not written out.

    Null and empty texts have none; texts are taken whole; rows repeated with the same id are
    reported each; an empty table gives an empty result; further columns are ignored. Only texts
    that pass MAY_HOLD, which holds wherever anything can be found, leave the JVM.
    """
    return _texts(df, id_col, text_col).filter(F.col("text").rlike(MAY_HOLD)).mapInPandas(_scan, "id long, ordinal int, kind string, start int, length int")


def redacted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the text with its secrets masked; every row of the input, null texts as null."""
    texts = _texts(df, id_col, text_col)
    may = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    return texts.filter(~may).unionByName(texts.filter(may).mapInPandas(_mask, "id long, text string"))
