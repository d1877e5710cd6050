"""Typed values of the formula language: a Column, its kind, and a Column with the error in band, if any."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUM, TEXT, BOOL, DATE, EMPTY, ARRAY = "num", "text", "bool", "date", "empty", "array"
VALUE_ERROR, NUM_ERROR, NA, DIV_ERROR = "#VALUE!", "#NUM!", "#N/A", "Division by zero"
EPOCH = "1899-12-30"


@dataclass
class V:
    """``err`` is None where no error can occur; ``strict`` says that ``col`` is null wherever there is one, so that
    the value needs no test for it.  ``depth`` counts the named calls that a value is built on."""

    col: Column
    kind: str
    err: Column | None = None
    literal: object = None
    aggregate: bool = False
    strict: bool = False
    depth: int = 0

    def value(self) -> Column:
        return self.col if self.err is None or self.strict else F.when(self.err.isNull(), self.col)


def lit(x) -> V:
    if x is None:
        return V(F.lit(None), EMPTY)
    if isinstance(x, bool):
        return V(F.lit(x), BOOL, literal=x)
    if isinstance(x, (int, float)):
        return V(F.lit(float(x)), NUM, literal=float(x))
    return V(F.lit(str(x)), TEXT, literal=str(x))


def of_column(col: Column, dtype: T.DataType) -> V:
    if isinstance(dtype, T.BooleanType):
        return V(col, BOOL)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return V(col, DATE)
    if isinstance(dtype, T.NumericType):
        return V(col.cast("double"), NUM)
    if isinstance(dtype, T.ArrayType):
        return V(col, ARRAY)
    return V(col.cast("string"), TEXT)


def error(code: str) -> V:
    return V(F.lit(None).cast("double"), NUM, F.lit(code), strict=True)


def first_error(*errs: Column | None) -> Column | None:
    some = [e for e in errs if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def serial(col: Column) -> Column:
    """Days since 1899-12-30, with the time as a fraction."""
    ts = col.cast("timestamp")
    return (F.unix_micros(ts) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))).cast("double") / F.lit(86400e6)


def from_serial(col: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(col).cast("int"))


def number(v: V) -> Column:
    """n(x): numbers and dates as double; booleans, text and empty cells are none (null)."""
    if v.kind == NUM:
        return v.value()
    if v.kind == DATE:
        return serial(v.value())
    return F.lit(None).cast("double")


def number_a(v: V) -> Column:
    """a(x): numbers, booleans as 0 or 1, text as 0; empty cells none."""
    if v.kind == BOOL:
        return v.value().cast("double")
    if v.kind == TEXT:
        return F.when(v.value().isNotNull(), F.lit(0.0))
    return number(v)


def number_arg(v: V) -> V:
    """As a scalar argument: what is no number is an error."""
    n = number(v)
    missing = F.when(n.isNull(), F.lit(VALUE_ERROR))
    return V(n, NUM, missing if v.err is None else F.coalesce(v.err, missing), v.literal, v.aggregate, True)


def plain_text(col: Column) -> Column:
    """A double as text: no exponent, no trailing ``.0``."""
    s = F.format_string("%.15f", col)
    whole = (F.abs(col) < 1e15) & (col == F.floor(col))
    short = F.when(whole, col.cast("decimal(38,0)").cast("string")).otherwise(col.cast("string"))
    return F.when(short.contains("E"), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(short)


def text(v: V) -> Column:
    """t(x): booleans as TRUE or FALSE, empty as ''; an error as its message."""
    if v.kind == TEXT:
        out = F.coalesce(v.col, F.lit(""))
    elif v.kind == BOOL:
        out = F.when(v.col, "TRUE").when(~v.col, "FALSE").otherwise("")
    elif v.kind == EMPTY:
        out = F.lit("")
    else:
        out = F.coalesce(plain_text(number(v)), F.lit(""))
    return out if v.err is None else F.coalesce(v.err, out)


def truth(v: V) -> Column:
    """b(x): numbers unequal to 0, non-empty text (even "FALSE"); empty and errors are false."""
    if v.kind == BOOL:
        out = F.coalesce(v.value(), F.lit(False))
    elif v.kind == TEXT:
        out = F.coalesce(F.length(v.value()) > 0, F.lit(False))
    elif v.kind == EMPTY:
        out = F.lit(False)
    else:
        out = F.coalesce(number(v) != 0, F.lit(False))
    return out


def is_blank(v: V) -> Column:
    if v.kind == TEXT:
        return F.coalesce(v.value(), F.lit("")) == ""
    return F.lit(True) if v.kind == EMPTY else v.value().isNull()
