"""How a column writes its numbers: which character groups digits and which one is the decimal point."""

from __future__ import annotations

import re
from dataclasses import dataclass

GROUPERS = "'’   "


@dataclass(frozen=True)
class NumberFormat:
    thousands: str | None = None
    decimal: str | None = None
    scale: int = 0
    ambiguous: bool = False


def roles(value: str) -> dict[str, set[str]] | None:
    """What each separator of one value can be: ``thousands``, ``decimal`` or both. None if the value is no number."""
    body = re.sub(r"^[+-]", "", value)
    if not re.fullmatch(rf"\d[\d.,{GROUPERS}]*\d|\d|[.,]\d+", body):
        return None
    found = {c: [m.start() for m in re.finditer(re.escape(c), body)] for c in set(body) if not c.isdigit()}
    if not found:
        return {}
    last = max(found, key=lambda c: found[c][-1])
    out: dict[str, set[str]] = {}
    for c, at in found.items():
        edges = [*at, len(body)]
        widths = [len(re.sub(r"\D", "", body[a + 1 : b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        by_three = at[0] <= 3 and at[0] > 0 and all(re.fullmatch(r"\d{3}", body[a + 1 : a + 4]) and not body[a + 4 : a + 5].isdigit() for a in at)
        can: set[str] = set()
        if c in GROUPERS or by_three:
            can.add("thousands")
        if c not in GROUPERS and len(at) == 1 and c == last:
            can.add("decimal")
        if len(found) > 1 and c != last:
            can.discard("decimal")
        if len(found) > 1 and c == last and len(at) == 1 and c not in GROUPERS:
            can = {"decimal"}
        if not can or (not widths[-1] and c != last):
            return None
        out[c] = can
    return out


def infer(values: list[str]) -> NumberFormat | None:
    """The one convention that reads all values, or None.

    Two separators settle their roles by order, a repeated one groups, a group that isn't three digits long
    is a fraction. A lone comma before three digits is then taken to group and a lone point to part, marked as ambiguous.
    """
    fixed: dict[str, str] = {}
    open_: set[str] = set()
    scale = 0
    seen = [(v, roles(v)) for v in values]
    if not seen or any(r is None for _, r in seen):
        return None
    for _, r in seen:
        for c, can in r.items():
            if len(can) == 1:
                role = next(iter(can))
                if fixed.setdefault(c, role) != role:
                    return None
            else:
                open_.add(c)
    ambiguous = False
    for c in sorted(open_ - set(fixed)):
        taken = set(fixed.values())
        if "decimal" in taken:
            fixed[c] = "thousands"
        elif any(fixed.get(o) == "thousands" and o != c for o in fixed):
            fixed[c] = "decimal"
        else:
            fixed[c] = "thousands" if c == "," else "decimal"
            ambiguous = True
    decimals = [c for c, role in fixed.items() if role == "decimal"]
    thousands = [c for c, role in fixed.items() if role == "thousands"]
    if len(decimals) > 1 or len(thousands) > 1:
        return None
    if decimals:
        scale = max(len(v.rsplit(decimals[0], 1)[1]) if decimals[0] in v else 0 for v, _ in seen)
    return NumberFormat(thousands[0] if thousands else None, decimals[0] if decimals else None, scale, ambiguous)


def double_keeps(text: str) -> bool:
    """Whether a double has every digit of a plain number."""
    digits = re.sub(r"\D", "", text).lstrip("0")
    if "." in text:
        return len(digits.rstrip("0")) <= 17
    return len(digits) <= 15 or int(float(text)) == int(text)


def leading_zero(text: str) -> bool:
    return bool(re.fullmatch(r"[+-]?0\d+", text))


def fits_long(text: str) -> bool:
    return bool(re.fullmatch(r"[+-]?\d+", text)) and -(2**63) <= int(text) < 2**63
