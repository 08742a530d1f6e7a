"""String helpers that work on whole columns, and their driver-side twins for names and shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that stand for a missing value when types are inferred, compared without case.
NA_WORDS = ("", "na", "n/a", "null", "none", "nil", "-", "–", "—", "#n/a", "#na", "nan", "k.a.", "keine")


def utrim(c: Column) -> Column:
    """Trims all Unicode white space; Spark's ``trim`` knows the space only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(utrim(c) == "", F.lit(True))


def shape(c: Column) -> Column:
    """A value's shape: digits become 9 (runs over eight 9+), runs of letters A or a (longer ones A+, a+), white space one space.

    Letters without case count as small. Digits go last, for their stand-ins are digits too.
    """
    out = F.regexp_replace(c, r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"\p{Lu}{2,}", "\ue000")
    out = F.regexp_replace(out, r"\p{Lu}", "\ue001")
    out = F.regexp_replace(out, r"\p{L}{2,}", "\ue002")
    out = F.regexp_replace(out, r"\p{L}", "\ue003")
    out = F.regexp_replace(out, r"\p{Nd}{9,}", "\ue004")
    out = F.regexp_replace(out, r"\p{Nd}", "9")
    for mark, text in (("\ue000", "A+"), ("\ue001", "A"), ("\ue002", "a+"), ("\ue003", "a"), ("\ue004", "9+")):
        out = F.replace(out, F.lit(mark), F.lit(text))
    return out


def sanitize(name: str) -> str:
    """A header as a column name: snake case, umlauts spelled out, never empty or led by a digit."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        name = name.replace(a, b)
    name = re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.strip().lower())).strip("_")
    return f"c_{name}" if name[:1].isdigit() else name or "col"


def unique(names: list[str]) -> list[str]:
    """Names with repeats numbered from 2; empty ones become ``col_N``. Names that differ in case only are repeats, as in SQL."""
    seen: set[str] = set()
    out = []
    for i, name in enumerate(names, 1):
        base = name or f"col_{i}"
        new, k = base, 2
        while new.lower() in seen:
            new, k = f"{base}_{k}", k + 1
        seen.add(new.lower())
        out.append(new)
    return out


def java_pattern(pattern: str) -> str:
    """A regular expression with ``(?P<name>`` groups as Java writes it. Look-around and back references are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=", pattern):
        raise ValueError(f"look-around and back references are not allowed: {pattern}")
    re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    return re.sub(r"\(\?P?<([A-Za-z_]\w*)>", lambda m: f"(?<{m[1].replace('_', 'Z')}>", pattern)


def groups(pattern: str) -> list[str]:
    """Names of the groups of a pattern, by their order."""
    found = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)).groupindex
    return sorted(found, key=found.get)


def group_number(pattern: str, name: str) -> int:
    return re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)).groupindex[name]
