"""Text tables: delimited, DIF, SYLK and fixed-width; parsers of one file's text, and writers.

Parsers give rows of cells; a cell is None, a bool, an int, a float or a str (see :func:`infer`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: Separators of the presets.
PRESETS = {"csv": ",", "tsv": "\t", "prn": " ", "pipe": "|", "semicolon": ";"}
_TRUE, _FALSE = {"TRUE", "YES", "ON"}, {"FALSE", "NO", "OFF"}


def infer(s: str):
    """Empty, then integer, float, boolean word, text."""
    if s == "":
        return None
    if re.fullmatch(r"[+-]?\d{1,18}", s):
        return int(s)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity|nan)", s, re.I):
        return float(s)
    up = s.upper()
    return True if up in _TRUE else False if up in _FALSE else s


def parse_delimited(text: str, separator: str = ",", comment: str | None = "#") -> Iterator[list]:
    """A quote opens or closes quoting wherever it stands; inside, a doubled quote or a backslash keeps the next
    sign; newlines belong to quoted fields; carriage returns outside quotes are dropped; a blank line is a row of
    one empty cell; lines that start with ``comment`` are skipped."""
    if '"' not in text and "\\" not in text:  # nothing to quote or keep: lines and fields are what they seem
        lines = text.replace("\r", "").split("\n")
        if lines[-1] == "":
            lines.pop()
        for line in lines:
            if not (comment and line.startswith(comment)):
                yield [infer(x) for x in line.split(separator)]
        return
    row: list[str] = []
    field: list[str] = []
    quoted, at, n, line_start = False, 0, len(text), True
    while at < n:
        c = text[at]
        if line_start and comment and c == comment:
            end = text.find("\n", at)
            at = n if end < 0 else end + 1
            continue
        line_start = False
        if quoted:
            if c == "\\" and at + 1 < n:
                field.append(text[at + 1])
                at += 1
            elif c == '"' and text[at + 1 : at + 2] == '"':
                field.append('"')
                at += 1
            elif c == '"':
                quoted = False
            else:
                field.append(c)
        elif c == '"':
            quoted = True
        elif c == separator:
            row.append("".join(field))
            field = []
        elif c == "\n":
            yield [infer(x) for x in [*row, "".join(field)]]
            row, field, line_start = [], [], True
        elif c != "\r":
            field.append(c)
        at += 1
    if row or field or quoted:
        yield [infer(x) for x in [*row, "".join(field)]]


def show(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return str(v)


def write_delimited(rows: Iterable[list], separator: str = ",") -> str:
    """Booleans are always quoted, text where it must be; no newline at the end."""

    def cell(v) -> str:
        s = show(v)
        if isinstance(v, bool) or (isinstance(v, str) and re.search(r'["\r\n\\]|' + re.escape(separator), s)):
            return '"' + s.replace("\\", "\\\\").replace('"', '""') + '"'
        return s

    return "\n".join(separator.join(map(cell, r)) for r in rows)


def parse_dif(text: str) -> Iterator[list]:
    """Header chunks up to DATA, then pairs of lines: ``-1,0`` with BOT or EOD, ``0,n`` with V, TRUE, FALSE, NA or
    ERROR, ``1,0`` with a text."""
    lines = text.replace("\r\n", "\n").split("\n")
    at = next((i for i, line in enumerate(lines) if line.strip().upper() == "DATA"), len(lines))
    at += 3
    row: list | None = None
    while at + 1 < len(lines):
        kind, _, number = lines[at].partition(",")
        value = lines[at + 1].strip()
        at += 2
        if kind.strip() == "-1":
            if row is not None:
                yield row
            row = []
            if value.upper() == "EOD":
                return
        elif row is not None and kind.strip() == "0":
            row.append({"TRUE": True, "FALSE": False, "NA": "#N/A", "ERROR": "#ERROR"}.get(value.upper(), infer(number.strip())))
        elif row is not None:
            s = value[1:-1].replace('""', '"') if value.startswith('"') else value
            row.append(s or None)


def write_dif(rows: list[list], title: str = "") -> str:
    width = max((len(r) for r in rows), default=0)
    out = ["TABLE", "0,1", f'"{title}"', "VECTORS", f"0,{width}", '""', "TUPLES", f"0,{len(rows)}", '""', "DATA", "0,0", '""']
    for r in rows:
        out += ["-1,0", "BOT"]
        for v in r:
            if isinstance(v, bool):
                out += [f"0,{int(v)}", str(v).upper()]
            elif isinstance(v, (int, float)):
                out += [f"0,{show(v)}", "V"]
            else:
                out += ["1,0", '"' + (v or "").replace('"', '""') + '"']
    return "\n".join([*out, "-1,0", "EOD", ""])


def parse_sylk(text: str) -> Iterator[list]:
    """C records place a value (K) at a row (Y) and column (X), which stay as they were where not given."""
    grid: dict[tuple[int, int], object] = {}
    y = x = 1
    for line in text.replace("\r", "").split("\n"):
        if not line.startswith("C;"):
            continue
        for part in re.split(r";(?!;)", line[2:].replace(";;", "\0")):
            key, value = part[:1], part[1:].replace("\0", ";")
            if key == "Y":
                y = int(value)
            elif key == "X":
                x = int(value)
            elif key == "K":
                grid[y, x] = value[1:-1].replace('""', '"') if value.startswith('"') else infer(value)
    for r in range(1, max((k[0] for k in grid), default=0) + 1):
        yield [grid.get((r, c)) for c in range(1, max(k[1] for k in grid) + 1)]


def write_sylk(rows: list[list]) -> str:
    out = ["ID;PTABULON"]
    for r, row in enumerate(rows, 1):
        for c, v in enumerate(row, 1):
            if v is not None:
                k = show(v) if not isinstance(v, str) else '"' + v.replace('"', '""').replace(";", ";;") + '"'
                out.append(f"C;Y{r};X{c};K{k}")
    return "\n".join([*out, "E", ""])


def column_widths(lines: list[str]) -> list[int]:
    """Columns end where at least half of the lines have white space and the next position mostly has none."""
    width = max(map(len, lines), default=0)
    blank = [2 * sum(i >= len(s) or s[i].isspace() for s in lines) >= len(lines) for i in range(width)]
    cuts = [i for i in range(1, width) if blank[i - 1] and not blank[i]]
    return [b - a for a, b in zip([0, *cuts], [*cuts, width], strict=True)] if width else []


def parse_fixed(text: str, widths: list[int] | None = None) -> Iterator[list]:
    lines = text.replace("\r", "").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    widths = widths or column_widths(lines)
    for line in lines:
        at, row = 0, []
        for w in widths:
            row.append(infer(line[at : at + w].strip()))
            at += w
        yield row


def write_fixed(rows: list[list], widths: list[int] | None = None) -> str:
    n = max((len(r) for r in rows), default=0)
    widths = widths or [max((len(show(r[i])) for r in rows if i < len(r)), default=0) + 1 for i in range(n)]
    return "\n".join("".join(show(v)[:w].ljust(w) for v, w in zip(r, widths, strict=False)).rstrip() for r in rows)
