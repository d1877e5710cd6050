"""Formulas over cells in long form: every workbook's rows of (path, sheet, row, col, tag, value), as readers give them.

``Sheet!A1``, ``'A sheet'!$B$2``, ``A1:B3`` and defined names are references.  All references of all formulas become
one aggregate pass over the cells, grouped by workbook: a cell is the value at its place, a range what its function
makes of the cells within it.  Formulas may use each other by name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.aggregates import AGGREGATES, ORDERED
from tabulon.functions.values import NUM, TEXT, VALUE_ERROR, V
from tabulon.plans import formula

_CELL = r"\$?([A-Za-z]{1,3})\$?([0-9]+)"
_REFERENCE = re.compile(rf"(?:(?:'((?:[^']|'')+)'|([A-Za-z_][\w.]*))!)?{_CELL}(?::{_CELL})?(?![\w(])")
_NUMBERS = ("int", "float", "datetime")
#: Functions to which cells with text are more than none.
_OF_TEXT = {"COUNTA", "COUNTBLANK"}
#: Of those that pair ranges with each other cell by cell, none can be had from one pass over single cells.
_PAIRED = {"SUMPRODUCT", "CORREL", "PEARSON", "RSQ", "COVAR", "COVARIANCE.P", "COVARIANCE.S", "SLOPE", "INTERCEPT", "STEYX", "SUMX2MY2", "SUMX2PY2", "SUMXMY2", "SUMIFS", "COUNTIFS", "AVERAGEIFS", "MINIFS", "MAXIFS", "PROB", "T.TEST", "TTEST", "F.TEST", "FTEST", "CHISQ.TEST", "CHITEST", *ORDERED}


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


class Grid(formula.Compiler):
    """Compiles formulas to aggregates over cells."""

    def __init__(self, cells: DataFrame, formulas: dict[str, str], names: dict[str, object] | None = None, sheet: str = "Sheet1"):
        super().__init__(cells, names)
        self.formulas = {k.upper(): f for k, f in formulas.items()}
        self.sheet, self.places, self.open = sheet, [], []

    def compile(self, source: str) -> V:
        """References become names that the grammar knows, but for those within text."""
        parts = re.split(r'("(?:[^"]|"")*")', source)
        for i in range(0, len(parts), 2):
            parts[i] = _REFERENCE.sub(self._place, parts[i])
        return super().compile("".join(parts))

    def _place(self, m: re.Match) -> str:
        quoted, plain, c0, r0, c1, r1 = m.groups()
        sheet = quoted.replace("''", "'") if quoted else plain or self.sheet
        cols = sorted((column_number(c0), column_number(c1 or c0)))
        rows = sorted((int(r0), int(r1 or r0)))
        self.places.append((sheet, rows, cols, c1 is not None))
        return f"__place{len(self.places) - 1}"

    def _within(self, i: int) -> Column:
        sheet, rows, cols, _ = self.places[i]
        return (F.col("sheet") == sheet) & F.col("row").between(*rows) & F.col("col").between(*cols)

    def _ref(self, name: str) -> V | formula.Range:
        if m := re.fullmatch(r"__place(\d+)", name):
            i = int(m[1])
            if self.places[i][3]:
                return formula.Range(name, [name])
            return self._cell(i)
        key = name.upper()
        if key in self.formulas:
            if key in self.open:
                raise formula.FormulaError(f"{name} refers to itself")
            self.open.append(key)
            out = self.compile(self.formulas[key])
            self.open.pop()
            return out
        v = self.names.get(key)
        if isinstance(v, str) and _REFERENCE.fullmatch(v):  # a defined name
            return self._ref(self._place(_REFERENCE.fullmatch(v)))
        if v is None:
            raise formula.FormulaError(f"unknown name {name}")
        return super()._ref(name)

    def _cell(self, i: int) -> V:
        """A number if the cell holds one, else an error to arithmetic; its text is what text functions see."""
        here = F.max(F.when(self._within(i) & F.col("tag").isin(*_NUMBERS), F.col("value").try_cast("double")))
        return V(here, NUM, F.when(F.max(F.when(self._within(i) & (F.col("tag") == "error"), F.col("value"))).isNotNull(), F.lit(VALUE_ERROR)), aggregate=True)

    def _range(self, r: formula.Range, name: str, args: list) -> V:
        here = self._within(int(r.name.removeprefix("__place")))
        criteria = next((a.literal for a in args if not isinstance(a, formula.Range)), None)
        as_text = name in _OF_TEXT or (name == "COUNTIF" and isinstance(criteria, str) and not re.search(r"\d\s*$", criteria))
        if as_text:
            return V(F.when(here, F.col("value")), TEXT)
        return V(F.when(here & F.col("tag").isin(*_NUMBERS), F.col("value").try_cast("double")), NUM)

    def _call(self, name: str, args: list, nodes: tuple) -> V:
        if any(isinstance(a, formula.Range) for a in args):
            if name == "ROWS" or name == "COLUMNS":
                _, rows, cols, _ = self.places[int(args[0].name.removeprefix("__place"))]
                lo, hi = rows if name == "ROWS" else cols
                return V(F.lit(float(hi - lo + 1)), NUM, literal=float(hi - lo + 1), aggregate=True)
            if name not in AGGREGATES or name in _PAIRED or (name in ("SUMIF", "AVERAGEIF") and len(args) > 2):
                raise formula.FormulaError(f"{name} takes no ranges of cells here")
            if name == "COUNTBLANK":
                _, rows, cols, _ = self.places[int(args[0].name.removeprefix("__place"))]
                full = self._range(args[0], name, args).col
                return V(F.lit(float((rows[1] - rows[0] + 1) * (cols[1] - cols[0] + 1))) - F.count_if(F.coalesce(full, F.lit("")) != ""), NUM, aggregate=True)
            scalars = [a for a in args if not isinstance(a, formula.Range) and a.aggregate]
            if scalars:
                raise formula.FormulaError(f"{name} takes ranges and constants, not cells among them")
            args = [self._range(a, name, args) if isinstance(a, formula.Range) else a for a in args]
            out = AGGREGATES[name](*args)
            out.aggregate = True
            return out
        return super()._call(name, args, nodes)


def evaluate(cells: DataFrame, formulas: dict[str, str], names: dict[str, object] | None = None, sheet: str = "Sheet1", by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(by, each formula's value and ``<name>_err``) of every workbook in ``cells``; references without a sheet are to
    ``sheet``.  A missing cell is empty: no number in a range, 0 to nothing, an error to arithmetic."""
    g = Grid(cells, formulas, names, sheet)
    out = []
    for k, f in formulas.items():
        v = g.compile(f)
        if not v.aggregate:
            v = V(F.max(v.col), v.kind, None if v.err is None else F.max(v.err))
        out += [v.value().alias(k), (v.err if v.err is not None else F.lit(None).cast("string")).alias(f"{k}_err")]
    return cells.groupBy(*by).agg(*out)
