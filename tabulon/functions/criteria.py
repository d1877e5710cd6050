"""The criteria mini-language: ``>=5``, ``<>x``, ``a*``; and criteria rectangles of database functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.values import V, number, text

_OPERATORS = (">=", "<=", "<>", ">", "<", "=")


def parse(spec: str) -> tuple[str, float | str]:
    """(operator, target): ``=`` where none is written; a target that reads as a number is one."""
    s = spec.strip()
    op = next((o for o in _OPERATORS if s.startswith(o)), "=")
    target = s.removeprefix(op).strip()
    if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)", target, re.I):
        return op, float(target)
    return op, target


def wildcard(pattern: str) -> str:
    """``*`` and ``?`` as a regular expression; there is no escape."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches(v: V, spec: str | float | int) -> Column:
    """Whether the cell meets the criteria: numbers never meet text and text never meets numbers, so ``<>5``
    skips text and empty cells; text is compared case-sensitively, wildcards only under = and <>."""
    op, target = ("=", float(spec)) if isinstance(spec, (int, float)) and not isinstance(spec, bool) else parse(str(spec))
    if isinstance(target, float):
        a, b = number(v), F.lit(target)
    else:
        a, b = text(v), F.lit(target)
        if op in ("=", "<>") and re.search(r"[*?]", target):
            like = a.rlike(wildcard(target))
            return like if op == "=" else ~like
    out = {"=": a == b, "<>": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    return F.coalesce(out, F.lit(False))


def rectangle(columns: dict[str, V], rows: list[dict[str, object]]) -> Column:
    """Criteria rows over named columns: all cells of a row, any of the rows.  A blank cell sets no condition;
    a row of blanks only is met by nothing."""
    options = []
    for row in rows:
        cells = [matches(columns[k], v) for k, v in row.items() if v not in (None, "")]
        if cells:
            options.append(reduce(lambda a, b: a & b, cells))
    return reduce(lambda a, b: a | b, options, F.lit(False))
