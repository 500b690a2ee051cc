"""SQL names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A dotted name's last part: quoted in any of the three ways, or bare.
LAST_PART = r"""(?s)("[^"]*"|`[^`]*`|\[[^\]]*\]|[^."`\[\]]+)\s*$"""


def bare_name(name: Column) -> Column:
    """The name without schema prefix, quote marks, brackets, outer blanks and letter case."""
    blank = r"[\s ]"
    outer = F.regexp_replace(name, f"^{blank}+|{blank}+$", "")
    last = F.regexp_extract(outer, LAST_PART, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(last, r'^["`\[]|["`\]]$', ""), f"^{blank}+|{blank}+$", ""))
