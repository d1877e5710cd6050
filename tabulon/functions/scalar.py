"""Scalar functions of the formula language as Column expressions.

Every entry of ``SCALARS`` maps a name to a function of values; ``numeric`` wraps those of numbers, which turn
an argument that is no number into an error, and a null result (outside the function's domain) into #NUM!.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import special
from tabulon.functions.values import ARRAY, BOOL, DATE, DIV_ERROR, EMPTY, NA, NUM, NUM_ERROR, TEXT, VALUE_ERROR, V, error, first_error, from_serial, is_blank, lit, number, number_arg, serial, text, truth

SCALARS: dict[str, Callable[..., V]] = {}


def scalar(*names: str):
    def register(f):
        SCALARS.update(dict.fromkeys(names, f))
        return f

    return register


def numeric(f: Callable[..., Column], bad: str = NUM_ERROR, strict: bool = False, flags: bool = False) -> Callable[..., V]:
    """``strict``: f gives null where any argument is null, of any other f only what has all arguments counts;
    ``flags``: booleans count as 0 and 1."""

    @wraps(f)
    def run(*args: V) -> V:
        n = [number_arg(V(a.col.cast("double"), NUM, a.err) if flags and a.kind == BOOL else a) for a in args]
        out = f(*[a.col for a in n])
        given = [a.col.isNotNull() for a in n if not isinstance(a.literal, float)]
        if given and not strict:
            out = F.when(reduce(lambda a, b: a & b, given), out)
        return V(out, NUM, first_error(*[a.err for a in n], F.when(out.isNull(), F.lit(bad))), strict=True)

    return run


def _sign(x: Column, y: Column) -> Column:
    return F.signum(x) * y


def _half_up(x: Column, d: Column) -> Column:
    f = F.pow(F.lit(10.0), d.cast("int").cast("double"))
    return F.signum(x) * F.floor(F.abs(x) * f + 0.5).cast("double") / f


def _down(x: Column, d: Column = None) -> Column:
    f = F.pow(F.lit(10.0), (F.lit(0.0) if d is None else d).cast("int").cast("double"))
    return F.signum(x) * F.floor(F.abs(x) * f).cast("double") / f


def _up(x: Column, d: Column) -> Column:
    f = F.pow(F.lit(10.0), d.cast("int").cast("double"))
    return F.signum(x) * F.ceil(F.abs(x) * f).cast("double") / f


def _floor(x: Column, s: Column) -> Column:
    return F.when(s != 0, F.floor(F.try_divide(x, s)).cast("double") * s)


def _ceil(x: Column, s: Column) -> Column:
    return F.when(s != 0, F.ceil(F.try_divide(x, s)).cast("double") * s)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def _long(f: Callable[..., Column], top: int = 1 << 48) -> Callable[..., Column]:
    """On non-negative whole numbers below 2**48."""
    return lambda a, b: F.when((a >= 0) & (b >= 0) & (a < top) & (b < top), f(a.cast("long"), b.cast("long")).cast("double"))


_MATH: dict[str, Callable[..., Column]] = {
    "ABS": F.abs, "INT": lambda x: F.floor(x).cast("double"), "ROUND": _half_up, "ROUNDDOWN": _down, "ROUNDUP": _up, "TRUNC": _down,
    "FLOOR": lambda x, s=None: _floor(x, F.lit(1.0) if s is None else s), "CEILING": lambda x, s=None: _ceil(x, F.lit(1.0) if s is None else s),
    "FLOOR.PRECISE": lambda x, s=None: _floor(x, F.lit(1.0) if s is None else F.abs(s)),
    "FLOOR.MATH": lambda x, s=None, m=None: F.when((x < 0) & ((F.lit(0.0) if m is None else m) != 0), _ceil(x, F.lit(1.0) if s is None else F.abs(s))).otherwise(_floor(x, F.lit(1.0) if s is None else F.abs(s))),
    "CEILING.MATH": lambda x, s=None, m=None: F.when((x < 0) & ((F.lit(0.0) if m is None else m) != 0), _floor(x, F.lit(1.0) if s is None else F.abs(s))).otherwise(_ceil(x, F.lit(1.0) if s is None else F.abs(s))),
    "MOD": lambda x, y: F.when(F.abs(y) >= 1e-12, x - y * F.floor(F.try_divide(x, y))),
    "MROUND": lambda x, m: F.when((F.abs(m) >= 1e-12) & ((x == 0) | (F.signum(x) == F.signum(m))), F.floor(F.try_divide(x, m) + 0.5) * m),
    "QUOTIENT": lambda a, b: F.when(b != 0, _sign(F.try_divide(a, b), F.floor(F.abs(F.try_divide(a, b))))),
    "EVEN": lambda x: F.signum(x) * F.ceil(F.abs(x) / 2) * 2, "SIGN": F.signum,
    "ODD": lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.signum(x) * (F.ceil((F.abs(x) + 1) / 2) * 2 - 1)),
    "POWER": F.pow, "SQRT": F.sqrt, "SQRTPI": lambda x: F.sqrt(x * math.pi), "EXP": F.exp, "LN": _log, "LOG10": lambda x: F.when(x > 0, F.log10(x)).otherwise(_log(x)),
    "LOG": lambda x, b=None: F.when((x > 0), F.log10(x) if b is None else F.try_divide(F.log(x), F.log(b))).otherwise(_log(x)), "PI": lambda: F.lit(math.pi),
    "DELTA": lambda a, b=None: F.when(a == (F.lit(0.0) if b is None else b), 1.0).otherwise(0.0), "GESTEP": lambda x, s=None: F.when(x >= (F.lit(0.0) if s is None else s), 1.0).otherwise(0.0),
    "BITAND": _long(lambda a, b: a.bitwiseAND(b)), "BITOR": _long(lambda a, b: a.bitwiseOR(b)), "BITXOR": _long(lambda a, b: a.bitwiseXOR(b)),
    "BITLSHIFT": lambda a, b: F.when((a >= 0) & (F.abs(b) <= 48), F.floor(a * F.pow(F.lit(2.0), b))), "BITRSHIFT": lambda a, b: F.when((a >= 0) & (F.abs(b) <= 48), F.floor(a / F.pow(F.lit(2.0), b))),
    "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "COT": lambda x: F.try_divide(F.lit(1.0), F.tan(x)), "CSC": lambda x: F.try_divide(F.lit(1.0), F.sin(x)), "SEC": lambda x: F.try_divide(F.lit(1.0), F.cos(x)),
    "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan, "ATAN2": F.atan2, "ACOT": lambda x: F.lit(math.pi / 2) - F.atan(x), "ACOTH": lambda x: F.when(F.abs(x) > 1, 0.5 * F.log(F.try_divide(x + 1, x - 1))),
    "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "CSCH": lambda x: F.try_divide(F.lit(1.0), F.sinh(x)), "SECH": lambda x: F.lit(1.0) / F.cosh(x), "COTH": lambda x: F.try_divide(F.cosh(x), F.sinh(x)),
    "ASINH": F.asinh, "ACOSH": F.acosh, "ATANH": F.atanh, "RADIANS": F.radians, "DEGREES": F.degrees, "PERMUTATIONA": lambda n, k: F.pow(F.floor(n).cast("double"), F.floor(k).cast("double")),
    "PHI": lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi), "FISHER": lambda x: F.when(F.abs(x) < 1, F.atanh(x)), "FISHERINV": F.tanh, "STANDARDIZE": lambda x, m, s: F.when(s > 0, F.try_divide(x - m, s)),
    "EXPON.DIST": lambda x, r, c: F.when((x >= 0) & (r > 0), F.when(c != 0, 1 - F.exp(-r * x)).otherwise(r * F.exp(-r * x))),
    "WEIBULL.DIST": lambda x, a, b, c: F.when((x >= 0) & (a > 0) & (b > 0), F.when(c != 0, 1 - F.exp(-F.pow(x / b, a))).otherwise(a / F.pow(b, a) * F.pow(x, a - 1) * F.exp(-F.pow(x / b, a)))),
}
_MATH |= {"CEILING.PRECISE": lambda x, s=None: _ceil(x, F.lit(1.0) if s is None else F.abs(s)), "EXPONDIST": _MATH["EXPON.DIST"], "WEIBULL": _MATH["WEIBULL.DIST"]}
_MATH["ISO.CEILING"] = _MATH["CEILING.PRECISE"]


def _annuity(r: Column, n: Column) -> Column:
    return F.when(F.abs(r) < 1e-12, n).otherwise(F.try_divide(F.pow(1 + r, n) - 1, r))


def _fv(r, n, pmt, pv=F.lit, kind=F.lit):
    pv, kind = (F.lit(0.0) if x is F.lit else x for x in (pv, kind))
    return -(pv * F.pow(1 + r, n) + pmt * (1 + r * kind) * _annuity(r, n))


def _pv(r, n, pmt, fv=None, kind=None):
    fv, kind = (F.lit(0.0) if x is None else x for x in (fv, kind))
    return -(fv + pmt * (1 + r * kind) * _annuity(r, n)) / F.pow(1 + r, n)


def _pmt(r, n, pv, fv=None, kind=None):
    fv, kind = (F.lit(0.0) if x is None else x for x in (fv, kind))
    return F.when(n != 0, -F.try_divide(pv * F.pow(1 + r, n) + fv, (1 + r * kind) * _annuity(r, n)))


def _ipmt(r, per, n, pv, fv=None, kind=None):
    k = F.lit(0.0) if kind is None else kind
    out = _fv(r, per - 1, _pmt(r, n, pv, fv, k), pv, k) * r
    return F.when((per >= 1) & (per <= n), F.when((per == 1) & (k == 1), F.lit(0.0)).otherwise(out))


def _nper(r, pmt, pv, fv=None, kind=None):
    fv, kind = (F.lit(0.0) if x is None else x for x in (fv, kind))
    q = pmt * (1 + r * kind)
    return F.when(F.abs(r) < 1e-12, -F.try_divide(pv + fv, pmt)).otherwise(F.log(F.try_divide(q - fv * r, q + pv * r)) / F.log(1 + r))


def _dollar(into_decimal: bool):
    def run(x, f):
        f = F.floor(f)
        power = F.pow(F.lit(10.0), F.ceil(F.log10(f)).cast("double"))
        whole = F.signum(x) * F.floor(F.abs(x))
        part = F.abs(x - whole)
        return F.when(f >= 1, whole + (part * power / f if into_decimal else part * f / power))

    return run


def _steps(period: Column, start: Column, each: Callable) -> Column:
    """Depreciation of the last of ``period`` periods; ``each(acc, i)`` gives struct(book, last)."""
    return F.aggregate(F.sequence(F.lit(1), F.ceil(period).cast("int")), F.struct(start.alias("book"), F.lit(0.0).alias("last")), each, lambda a: a["last"])


def _db(cost, salvage, life, period, month=None):
    month = F.lit(12.0) if month is None else month
    r = F.floor((1 - F.pow(F.try_divide(salvage, cost), 1 / life)) * 1000 + 0.5) / 1000

    def each(a, i):
        d = F.when(i == 1, cost * r * month / 12).when(i > life, a["book"] * r * (12 - month) / 12).otherwise(a["book"] * r)
        return F.struct((a["book"] - d).alias("book"), d.alias("last"))

    return F.when((cost > 0) & (life > 0) & (period >= 1), _steps(period, cost, each))


def _ddb(cost, salvage, life, period, factor=None):
    factor = F.lit(2.0) if factor is None else factor

    def each(a, i):
        d = F.greatest(F.least(a["book"] * factor / life, a["book"] - salvage), F.lit(0.0))
        return F.struct((a["book"] - d).alias("book"), d.alias("last"))

    return F.when((cost >= 0) & (life > 0) & (period >= 1) & (period <= life), _steps(period, cost, each))


_FINANCE: dict[str, Callable[..., Column]] = {
    "PV": _pv, "FV": _fv, "PMT": _pmt, "IPMT": _ipmt, "PPMT": lambda r, per, n, pv, fv=None, k=None: _pmt(r, n, pv, fv, k) - _ipmt(r, per, n, pv, fv, k), "NPER": _nper,
    "PDURATION": lambda r, pv, fv: F.when((r > 0) & (pv > 0) & (fv > 0), F.log(F.try_divide(fv, pv)) / F.log(1 + r)), "RRI": lambda n, pv, fv: F.when((n > 0) & (pv != 0), F.pow(F.try_divide(fv, pv), F.try_divide(F.lit(1.0), n)) - 1),
    "NOMINAL": lambda e, n: F.when((e > 0) & (n >= 1), F.floor(n) * (F.pow(1 + e, 1 / F.floor(n)) - 1)), "EFFECT": lambda i, n: F.when((i > 0) & (n >= 1), F.pow(1 + i / F.floor(n), F.floor(n).cast("double")) - 1),
    "ISPMT": lambda r, per, n, pv: F.when(n != 0, -pv * r * (1 - F.try_divide(per, n))), "SLN": lambda c, s, n: F.try_divide(c - s, n), "SYD": lambda c, s, n, p: F.when((n > 0) & (p >= 1) & (p <= n), (c - s) * (n - p + 1) * 2 / (n * (n + 1))),
    "DB": _db, "DDB": _ddb, "DOLLARDE": _dollar(True), "DOLLARFR": _dollar(False),
}
#: Functions whose result is null where an argument is.
_STRICT = set("ABS INT ROUND ROUNDDOWN ROUNDUP TRUNC FLOOR CEILING FLOOR.PRECISE CEILING.PRECISE ISO.CEILING MOD MROUND QUOTIENT EVEN ODD SIGN POWER SQRT SQRTPI EXP BITAND BITOR BITXOR BITLSHIFT BITRSHIFT".split())
_STRICT |= set("SIN COS TAN COT CSC SEC ASIN ACOS ATAN ATAN2 ACOT ACOTH SINH COSH TANH CSCH SECH COTH ASINH ACOSH ATANH RADIANS DEGREES PERMUTATIONA PHI FISHER FISHERINV STANDARDIZE RRI NOMINAL EFFECT ISPMT SYD PDURATION".split())
#: Functions that take TRUE and FALSE among their numbers.
_FLAGS = {"EXPON.DIST", "EXPONDIST", "WEIBULL.DIST", "WEIBULL", "FLOOR.MATH", "CEILING.MATH"}
for _table in (_MATH, _FINANCE):
    SCALARS.update({k: numeric(f, strict=k in _STRICT, flags=k in _FLAGS) for k, f in _table.items()})
SCALARS["SLN"] = numeric(_FINANCE["SLN"], DIV_ERROR)


def folded(f: Callable, *args) -> V:
    """The value of a function of literals."""
    try:
        out = f(*args)
    except (ArithmeticError, ValueError):
        out = None
    return error(NUM_ERROR) if out is None else lit(out)


def _by_udf(name: str):
    f, least = special.NUMERIC[name]

    @wraps(f)
    def run(*args: V) -> V:
        if len(args) < least:
            return error(VALUE_ERROR)
        if all(isinstance(a.literal, (float, bool)) for a in args):  # once, on the driver
            return folded(f, *[float(a.literal) for a in args])
        n = [number_arg(a) if a.kind != BOOL else V(a.col.cast("double"), NUM, a.err) for a in args]
        out = special.udf(f, "double", len(n))(*[F.when(a.err.isNull(), a.col) if a.err is not None else a.col for a in n])
        return V(out, NUM, first_error(*[a.err for a in n], F.when(out.isNull(), F.lit(NUM_ERROR))))

    return run


SCALARS.update({k: _by_udf(k) for k in special.NUMERIC})
SCALARS.update({k: SCALARS[v] for k, v in special.ALIASES.items()})


def _complex(name: str):
    f, kind = special.COMPLEX[name]

    @wraps(f)
    def run(*args: V) -> V:
        if all(isinstance(a.literal, str) for a in args):
            return folded(f, *[a.literal for a in args])
        out = special.udf(f, kind, len(args))(*[text(a) for a in args])
        return V(out, NUM if kind == "double" else TEXT, first_error(*[a.err for a in args], F.when(out.isNull(), F.lit(NUM_ERROR))))

    return run


SCALARS.update({k: _complex(k) for k in special.COMPLEX})


@scalar("COMPLEX")
def complex_(re: V, im: V, unit: V | None = None) -> V:
    mark = unit.literal if unit is not None else "i"
    out = special.udf(lambda a, b: special.format_complex(complex(a, b), mark), "string", 2)(number(re), number(im))
    return V(out, TEXT, F.when(out.isNull(), F.lit(VALUE_ERROR)))


# Number bases: digits and width of the two's complement


_BASES = {"BIN": (2, 10), "OCT": (8, 10), "HEX": (16, 10)}


def _to_dec(kind: str):
    base, width = _BASES[kind]

    def run(x: V) -> V:
        s = text(x)
        n = F.conv(s, base, 10).cast("double")
        top = float(base**width)
        ok = s.rlike({2: "^[01]{1,10}$", 8: "^[0-7]{1,10}$", 16: "^[0-9A-Fa-f]{1,10}$"}[base])
        out = F.when(ok, F.when(n >= top / 2, n - top).otherwise(n))
        return V(out, NUM, first_error(x.err, F.when(out.isNull(), F.lit(NUM_ERROR))))

    return run


def _from_dec(kind: str):
    base, width = _BASES[kind]

    def run(x: V, places: V | None = None) -> V:
        n = number_arg(x)
        whole = F.when(n.col >= 0, F.floor(n.col)).otherwise(F.ceil(n.col)).cast("long")
        top = base**width
        digits = F.conv(F.when(whole < 0, whole + top).otherwise(whole).cast("string"), 10, base)
        if places is not None:
            p = number(places).cast("int")
            digits = F.when(whole < 0, digits).when(F.length(digits) <= p, F.lpad(digits, p, "0"))
        out = F.when((whole >= -top // 2) & (whole < top // 2), digits)
        return V(out, TEXT, first_error(n.err, F.when(out.isNull(), F.lit(NUM_ERROR))))

    return run


def _rebased(a: str, b: str):
    return lambda x, places=None: _from_dec(b)(_to_dec(a)(x), *([] if places is None else [places]))


for _a in _BASES:
    SCALARS[f"{_a}2DEC"], SCALARS[f"DEC2{_a}"] = _to_dec(_a), _from_dec(_a)
    for _b in _BASES:
        if _a != _b:
            SCALARS[f"{_a}2{_b}"] = _rebased(_a, _b)


@scalar("DECIMAL")
def decimal(s: V, radix: V) -> V:
    out = F.conv(text(s), int(radix.literal), 10).cast("double")
    return V(out, NUM, F.when(out.isNull(), F.lit(NUM_ERROR)))


@scalar("BASE")
def base(x: V, radix: V, least: V | None = None) -> V:
    n = number_arg(x)
    out = F.conv(F.floor(n.col).cast("long").cast("string"), 10, int(radix.literal))
    if least is not None:
        out = F.lpad(out, F.greatest(F.length(out), F.lit(int(least.literal))), "0")
    return V(out, TEXT, n.err)


def _euclid(a: Column, b: Column) -> Column:
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(a.alias("x"), b.alias("y")), lambda s, i: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y"))), lambda s: s["x"])
    return steps


def _fold(f: Callable[[Column, Column], Column]):
    def run(*args: V) -> V:
        n = [number_arg(a) for a in args]
        out = F.abs(F.floor(n[0].col)).cast("long")
        for a in n[1:]:
            out = f(out, F.abs(F.floor(a.col)).cast("long"))
        return V(out.cast("double"), NUM, first_error(*[a.err for a in n]))

    return run


SCALARS["GCD"] = _fold(_euclid)
SCALARS["LCM"] = _fold(lambda a, b: F.coalesce(F.try_divide(a * b, _euclid(a, b)).cast("long"), F.lit(0).cast("long")))


# Logic and information


def _common(*values: V) -> str:
    kinds = {v.kind for v in values if v.kind != EMPTY}
    return kinds.pop() if len(kinds) == 1 else TEXT


def _as(v: V, kind: str) -> Column:
    return v.col if v.kind == kind else F.lit(None) if v.kind == EMPTY else text(V(v.col, v.kind))


def _choose(conditions: list[tuple[Column, V]], otherwise: V) -> V:
    kind = _common(*[v for _, v in conditions], otherwise)
    none = F.lit(None).cast("string")
    out, err = None, None
    for c, v in conditions:
        e = none if v.err is None else v.err
        out, err = (F.when(c, _as(v, kind)), F.when(c, e)) if out is None else (out.when(c, _as(v, kind)), err.when(c, e))
    return V(out.otherwise(_as(otherwise, kind)), kind, err.otherwise(none if otherwise.err is None else otherwise.err))


@scalar("IF")
def if_(condition: V, yes: V, no: V | None = None) -> V:
    out = _choose([(truth(condition), yes)], no or lit(False))
    return V(out.col, out.kind, first_error(condition.err, out.err))


@scalar("IFS")
def ifs(*args: V) -> V:
    out = _choose([(truth(c), v) for c, v in zip(args[::2], args[1::2], strict=True)], V(F.lit(None).cast("string"), EMPTY, F.lit(NA)))
    return V(out.col, out.kind, first_error(*[c.err for c in args[::2]], out.err))


@scalar("SWITCH")
def switch(x: V, *args: V) -> V:
    pairs = list(zip(args[: len(args) // 2 * 2 : 2], args[1::2], strict=False))
    rest = args[-1] if len(args) % 2 else V(F.lit(None).cast("string"), EMPTY, F.lit(NA))
    same = lambda v: (x.col == v.col) if x.kind == v.kind else F.lit(False)
    out = _choose([(F.coalesce(same(k), F.lit(False)), v) for k, v in pairs], rest)
    return V(out.col, out.kind, first_error(x.err, out.err))


SCALARS["TRUE"], SCALARS["FALSE"] = (lambda: lit(True)), (lambda: lit(False))
SCALARS["NOT"] = lambda x: V(~truth(x), BOOL, x.err)
SCALARS["NA"] = lambda: error(NA)
_none = lambda x: F.lit(None).cast("string") if x.err is None else x.err


@scalar("IFERROR")
def iferror(x: V, other: V) -> V:
    return _choose([(_none(x).isNotNull(), other)], V(x.col, x.kind))


@scalar("IFNA")
def ifna(x: V, other: V) -> V:
    return _choose([(F.coalesce(_none(x) == NA, F.lit(False)), other)], x)


_bool = lambda c: V(c, BOOL)
SCALARS |= {
    "ISBLANK": lambda x: _bool(is_blank(x) & _none(x).isNull()), "ISERROR": lambda x: _bool(_none(x).isNotNull()), "ISERR": lambda x: _bool(_none(x).isNotNull() & (F.upper(_none(x)) != NA)), "ISNA": lambda x: _bool(F.coalesce(F.upper(_none(x)) == NA, F.lit(False))),
    "ISNUMBER": lambda x: _bool(number(x).isNotNull() & _none(x).isNull()), "ISTEXT": lambda x: _bool(x.col.isNotNull() & _none(x).isNull() if x.kind == TEXT else F.lit(False)), "ISLOGICAL": lambda x: _bool(x.col.isNotNull() & _none(x).isNull() if x.kind == BOOL else F.lit(False)),
    "ISNONTEXT": lambda x: _bool(~(x.col.isNotNull() & _none(x).isNull()) if x.kind == TEXT else F.lit(True)), "INFO": lambda x: lit({"recalc": "Automatic", "system": "pcdos"}[x.literal.lower()]) if str(x.literal).lower() in ("recalc", "system") else error(NA),
    "TYPE": lambda x: V(F.lit({TEXT: 2.0, BOOL: 4.0, ARRAY: 64.0}.get(x.kind, 1.0)), NUM, x.err), "T": lambda x: V(text(x) if x.kind == TEXT else F.lit(""), TEXT, x.err),
    "N": lambda x: V(F.coalesce(x.col.cast("double") if x.kind == BOOL else number(x), F.lit(0.0)), NUM, x.err), "ISREF": lambda x: lit(x.literal is None and x.kind != EMPTY), "FORMULATEXT": lambda x: V(text(x), TEXT, F.when(~F.startswith(text(x), F.lit("=")), F.lit(NA))),
    "ISFORMULA": lambda x: _bool(F.startswith(text(x), F.lit("="))),
}


def _parity(odd: int):
    def run(x: V) -> V:
        n = number_arg(x)
        return V(F.pmod(F.floor(F.abs(n.col)), F.lit(2)) == odd, BOOL, n.err)

    return run


SCALARS["ISEVEN"], SCALARS["ISODD"] = _parity(0), _parity(1)


@scalar("VALUE")
def value(x: V) -> V:
    out = number(x) if x.kind != TEXT else F.trim(x.col).try_cast("double")
    return V(out, NUM, first_error(x.err, F.when(out.isNull(), F.lit(VALUE_ERROR))))


@scalar("CHOOSE")
def choose(i: V, *values: V) -> V:
    n = number_arg(i)
    out = _choose([(F.coalesce(F.floor(n.col) == k + 1, F.lit(False)), v) for k, v in enumerate(values)], V(F.lit(None).cast("string"), EMPTY, F.lit(VALUE_ERROR)))
    return V(out.col, out.kind, first_error(n.err, out.err))


# Text


def textual(f: Callable[..., Column], kind: str = TEXT):
    @wraps(f)
    def run(*args: V) -> V:
        return V(f(*args), kind, first_error(*[a.err for a in args]))

    return run


_int = lambda v, default=1: F.lit(default) if v is None else F.floor(number(v)).cast("int")
#: Half-width and full-width forms.
_HALF, _FULL = " " + "".join(map(chr, range(0x21, 0x7F))), "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))


def _find(fold: bool):
    def run(needle: V, s: V, start: V | None = None) -> V:
        a, b = (F.lower(text(x)) if fold else text(x) for x in (needle, s))
        at = F.call_function("locate", a, b, _int(start))
        out = F.when((F.length(a) > 0) & (at > 0), at.cast("double"))
        return V(out, NUM, first_error(needle.err, s.err, F.when(out.isNull(), F.lit(VALUE_ERROR))))

    return run


def _mid(s: V, start: V, n: V) -> V:
    a, b = _int(start), _int(n)
    out = F.when((a >= 1) & (b >= 0), F.substring(text(s), a, b))
    return V(out, TEXT, first_error(s.err, F.when(out.isNull(), F.lit(VALUE_ERROR))))


def _replace(s: V, start: V, n: V, new: V) -> V:
    t, a, b = text(s), _int(start), _int(n)
    out = F.concat(F.substring(t, F.lit(1), a - 1), F.when(a <= F.length(t), text(new)).otherwise(""), F.substring(t, a + b, F.length(t)))
    return V(out, TEXT, first_error(s.err, F.when((a < 1) | (b < 0), F.lit(VALUE_ERROR))))


def _substitute(s: V, old: V, new: V, nth: V | None = None) -> V:
    t, o, w = text(s), text(old), text(new)
    if nth is None:
        return V(F.when(o == "", t).otherwise(F.replace(t, o, w)), TEXT, first_error(s.err, old.err, new.err))
    k = int(nth.literal)
    head = F.call_function("substring_index", t, o, F.lit(k))
    tail = F.substring(t, F.length(head) + F.length(o) + 1, F.length(t))
    return V(F.when((o == "") | (F.length(head) == F.length(t)), t).otherwise(F.concat(head, w, tail)), TEXT, first_error(s.err, old.err, new.err))


def _part(after: bool):
    def run(s: V, mark: V, nth: V | None = None, *rest: V) -> V:
        t, m, k = text(s), text(mark), 1 if nth is None else int(nth.literal)
        if rest and rest[0].literal == 1.0:
            t0, m = F.lower(t), F.lower(m)
        else:
            t0 = t
        cut = F.call_function("substring_index", t0, m, F.lit(k))
        before = F.length(cut) if k > 0 else F.length(t) - F.length(cut) - F.length(m)
        found = (F.length(m) > 0) & (before < F.length(t)) & (before >= 0)
        out = F.when(found, F.substring(t, before + F.length(m) + 1, F.length(t)) if after else F.substring(t, F.lit(1), before))
        return V(out, TEXT, first_error(s.err, mark.err, F.when(out.isNull(), F.lit(NA))))

    return run


def _fixed(money: bool):
    def run(x: V, digits: V | None = None, plain: V | None = None) -> V:
        n, d = number_arg(x), 2 if digits is None else int(digits.literal)
        v = _half_up(n.col, F.lit(float(d)))
        body = F.format_number(F.abs(v), max(d, 0))
        if plain is not None:
            body = F.when(truth(plain), F.replace(body, F.lit(","), F.lit(""))).otherwise(body)
        return V(F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$" if money else ""), body), TEXT, n.err)

    return run


def _proper(s: V) -> Column:
    """Any non-letter starts a word."""
    low = F.lower(text(s))
    parts = F.regexp_extract_all(low, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def _bytes(f: Callable[..., str]) -> Callable[..., V]:
    """Functions that count double-width characters (above U+00FF) as two."""

    @wraps(f)
    def run(*args: V) -> V:
        out = special.udf(f, "string", len(args))(*[text(a) if a.kind == TEXT else number(a) for a in args])
        return V(out, TEXT, first_error(*[a.err for a in args], F.when(out.isNull(), F.lit(VALUE_ERROR))))

    return run


def width(c: str) -> int:
    return 1 if ord(c) <= 0xFF else 2


def leftb(s: str, n: float = 1) -> str:
    out, at = "", 0
    for c in s:
        at += width(c)
        if at > n:
            break
        out += c
    return out


def midb(s: str, start: float, n: float) -> str:
    at, out, used = 1, "", 0
    for c in s:
        if at >= start and used + width(c) <= n:
            out += c
            used += width(c)
        elif at >= start:
            break
        at += width(c)
    return out


def _find_bytes(fold: bool):
    def find(a: str, b: str, start: float = 1) -> float | None:
        if fold:
            a, b = a.lower(), b.lower()
        skip = len(leftb(b, start - 1))
        at = b.find(a, skip) if a else -1
        return None if at < 0 else float(sum(map(width, b[:at])) + 1)

    @wraps(find)
    def run(*args: V) -> V:
        out = special.udf(find, "double", len(args))(*[text(a) if a.kind == TEXT else number(a) for a in args])
        return V(out, NUM, first_error(*[a.err for a in args], F.when(out.isNull(), F.lit(VALUE_ERROR))))

    return run


SCALARS |= {
    "LEN": textual(lambda s: F.length(text(s)).cast("double"), NUM), "LENB": textual(lambda s: F.octet_length(text(s)).cast("double"), NUM), "LOWER": textual(lambda s: F.lower(text(s))), "UPPER": textual(lambda s: F.upper(text(s))),
    "ASC": textual(lambda s: F.translate(text(s), _FULL, _HALF)), "JIS": textual(lambda s: F.translate(text(s), _HALF, _FULL)), "DBCS": textual(lambda s: F.translate(text(s), _HALF, _FULL)), "PROPER": textual(_proper),
    "TRIM": textual(lambda s: F.regexp_replace(text(s), r"^[\s  - 　]+|[\s  - 　]+$", "")), "CONCAT": textual(lambda *s: F.concat(*map(text, s))), "CONCATENATE": textual(lambda *s: F.concat(*map(text, s))),
    "TEXTJOIN": textual(lambda d, skip, *s: F.array_join(F.filter(F.array(*map(text, s)), lambda x: ~truth(skip) | (x != "")), d.literal)), "CHAR": textual(lambda n: F.chr(number(n).cast("int"))), "UNICHAR": textual(lambda n: special.udf(lambda x: chr(int(x)), "string", 1)(number(n))),
    "CODE": textual(lambda s: F.when(F.length(text(s)) > 0, F.ascii(text(s)).cast("double")), NUM), "UNICODE": textual(lambda s: F.when(F.length(text(s)) > 0, F.ascii(text(s)).cast("double")), NUM), "CLEAN": textual(lambda s: F.regexp_replace(text(s), r"[\x00-\x1F]", "")),
    "FIXED": _fixed(False), "DOLLAR": _fixed(True), "LEFT": textual(lambda s, n=None: F.substring(text(s), F.lit(1), _int(n))), "RIGHT": textual(lambda s, n=None: F.right(text(s), _int(n))), "MID": _mid, "REPLACE": _replace,
    "REPT": textual(lambda s, n: F.repeat(text(s), _int(n))), "EXACT": textual(lambda a, b: text(a) == text(b), BOOL), "FIND": _find(False), "SEARCH": _find(True), "FINDB": _find_bytes(False), "SEARCHB": _find_bytes(True), "PHONETIC": textual(lambda s: text(s) if s.kind == TEXT else F.lit("")),
    "SUBSTITUTE": _substitute, "VALUETOTEXT": textual(lambda s, f=None: F.concat(F.lit('"'), text(s), F.lit('"')) if f is not None and f.literal == 1.0 and s.kind == TEXT else text(s)), "TEXTBEFORE": _part(False), "TEXTAFTER": _part(True),
    "TEXTSPLIT": textual(lambda s, d, *r: F.element_at(F.split(text(s), F.concat(F.lit("\\Q"), text(d), F.lit("\\E"))), 1)), "ROMAN": textual(lambda n, *r: special.udf(special.roman, "string", 1)(number(n))), "ARABIC": textual(lambda s: special.udf(special.arabic, "double", 1)(text(s)), NUM),
    "LEFTB": _bytes(leftb), "RIGHTB": _bytes(lambda s, n=1: leftb(s[::-1], n)[::-1]), "MIDB": _bytes(midb), "REPLACEB": _bytes(lambda s, a, n, new: leftb(s, a - 1) + new + s[len(leftb(s, a - 1 + n)) :]),
    "ENCODEURL": textual(lambda s: F.replace(F.url_encode(text(s)), F.lit("+"), F.lit("%20"))), "FILTERXML": textual(lambda s, p: F.xpath_string(text(s), F.lit(p.literal))), "ARRAYTOTEXT": textual(lambda s, f=None: F.array_join(s.col.cast("array<string>"), ", ")),
}


@scalar("NUMBERVALUE")
def numbervalue(s: V, point: V | None = None, group: V | None = None) -> V:
    t = F.trim(text(s))
    if group is not None:
        t = F.replace(t, text(group), F.lit(""))
    if point is not None and point.literal != ".":
        t = F.replace(t, text(point), F.lit("."))
    out = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))
    return V(out, NUM, first_error(s.err, F.when(out.isNull(), F.lit(VALUE_ERROR))))


def _mask(fmt: str) -> str:
    """A date mask in Spark's letters; minutes are an m after h or before s."""
    out = fmt.replace("YYYY", "yyyy").replace("DD", "dd").replace("AM/PM", "a")
    for long_, short in (("hh:mm", "HH:\0\0"), ("mm:ss", "\0\0:ss")):
        out = out.replace(long_, short)
    return out.replace("mmmm", "MMMM").replace("mmm", "MMM").replace("mm", "MM").replace("\0\0", "mm").replace("dddd", "EEEE").replace("ddd", "EEE")


@scalar("TEXT")
def text_(x: V, fmt: V) -> V:
    """Masks of digits (0, #, thousands, %, exponent-free) and of dates."""
    f = str(fmt.literal)
    if any(c in f.lower() for c in "ymdhs") and "0" not in f and "#" not in f:
        day = x.col.cast("timestamp") if x.kind == DATE else F.timestamp_micros((number(x) * 86400e6).cast("long") + F.unix_micros(F.lit("1899-12-30").cast("timestamp")))
        return V(F.date_format(day, _mask(f)), TEXT, x.err)
    n = number_arg(x)
    percent = f.endswith("%")
    digits = len(f.rstrip("%").partition(".")[2].replace("#", "0"))
    v = _half_up(n.col * (100 if percent else 1), F.lit(float(digits)))
    body = F.format_number(F.abs(v), digits)
    if "," not in f:
        body = F.replace(body, F.lit(","), F.lit(""))
    least = f.partition(".")[0].replace(",", "").count("0")
    if least > 1:
        body = F.lpad(body, F.greatest(F.length(body), F.lit(least + (digits + 1 if digits else 0))), "0")
    return V(F.concat(F.when(v < 0, "-").otherwise(""), body, F.lit("%" if percent else "")), TEXT, n.err)


# Dates


def day(v: V) -> Column:
    if v.kind == DATE:
        return F.to_date(v.value())
    if v.kind == TEXT:
        return F.coalesce(F.try_to_timestamp(v.value(), F.lit("yyyy-MM-dd")), F.try_to_timestamp(v.value(), F.lit("MM/dd/yyyy"))).cast("date")
    return from_serial(number(v))


def dated(f: Callable[..., Column], kind: str = NUM):
    @wraps(f)
    def run(*args: V) -> V:
        out = f(*args)
        return V(out if kind == DATE else out.cast("double"), kind, first_error(*[a.err for a in args], F.when(out.isNull(), F.lit(VALUE_ERROR))))

    return run


def _time(v: V) -> Column:
    """Seconds of the day."""
    n = number(v)
    return F.floor((n - F.floor(n)) * 86400 + 0.5)


def _clamped_months(a: Column, b: Column) -> Column:
    """Whole months from a to b."""
    n = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return F.when(F.add_months(a, n) > b, n - 1).otherwise(n)


def _datedif(start: V, end: V, unit: V) -> Column:
    x, y = day(start), day(end)
    a, b = F.least(x, y), F.greatest(x, y)
    m = _clamped_months(a, b)
    return {"Y": F.floor(m / 12), "M": m, "D": F.datediff(b, a), "MD": F.datediff(b, F.add_months(a, m)), "YM": F.pmod(m, F.lit(12)), "YD": F.datediff(b, F.add_months(a, F.floor(m / 12).cast("int") * 12))}[str(unit.literal).upper()]


def _days360(a: Column, b: Column, european: bool) -> Column:
    d1, d2 = F.least(F.dayofmonth(a), F.lit(30)), F.dayofmonth(b)
    d2 = F.least(d2, F.lit(30)) if european else F.when((d2 == 31) & (d1 == 30), F.lit(30)).otherwise(d2)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1


def _yearfrac(start: V, end: V, basis: V | None = None) -> Column:
    x, y = day(start), day(end)
    a, b, k = F.least(x, y), F.greatest(x, y), 0 if basis is None else int(basis.literal)
    if k in (0, 4):
        return _days360(a, b, k == 4) / 360.0
    if k in (2, 3):
        return F.datediff(b, a) / (360.0 if k == 2 else 365.0)
    years = F.year(b) - F.year(a) + 1
    span = F.datediff(F.make_date(F.year(b) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(a), F.lit(1), F.lit(1)))
    return F.datediff(b, a) / (span / years)


#: Days off of the weekend codes, Monday 0.
_WEEKENDS = {1: (5, 6), 2: (6, 0), 3: (0, 1), 4: (1, 2), 5: (2, 3), 6: (3, 4), 7: (4, 5)} | {11 + i: ((6 + i) % 7,) for i in range(7)}


def _weekend(v: V | None) -> list[int]:
    if v is None:
        return [5, 6]
    if isinstance(v.literal, str):
        return [i for i, c in enumerate(v.literal) if c == "1"]
    return list(_WEEKENDS[int(v.literal)])


def _working(a: Column, b: Column, off: list[int], holidays: list[V]) -> Column:
    """Working days of [a, b]: whole weeks by count, the rest one by one, and holidays that fall on them."""
    days = F.datediff(b, a) + 1
    weeks = F.floor(days / 7)
    first = F.weekday(a)
    rest = sum((F.when(F.pmod(first + i, F.lit(7)).isin(off) | (F.lit(i) >= days - weeks * 7), 0).otherwise(1) for i in range(6)), F.lit(0))
    n = weeks * (7 - len(set(off))) + rest
    for h in holidays:
        d = day(h)
        n = n - F.when((d >= a) & (d <= b) & ~F.weekday(d).isin(off), 1).otherwise(0)
    return n


def _networkdays(start: V, end: V, off: list[int], holidays: list[V]) -> Column:
    x, y = day(start), day(end)
    n = _working(F.least(x, y), F.greatest(x, y), off, holidays)
    return F.when(x <= y, n).otherwise(-n)


def _workday(start: V, n: V, off: list[int], holidays: list[V]) -> Column:
    """The n-th working day after (before) start: the first day that has as many between."""
    a, k = day(start), F.floor(number(n)).cast("int")
    reach = F.floor(F.abs(k) * 7 / max(1, 7 - len(set(off)))).cast("int") + 8 + len(holidays)
    step = F.when(k < 0, F.lit(-1)).otherwise(F.lit(1))
    free = F.filter(F.transform(F.sequence(F.lit(1), reach), lambda i: F.date_add(a, (i * step).cast("int"))), lambda d: ~F.weekday(d).isin(off) & ~(d.isin([day(h) for h in holidays]) if holidays else F.lit(False)))
    return F.when(k == 0, a).otherwise(F.element_at(free, F.greatest(F.abs(k), F.lit(1))))


def _date(y: V, m: V, d: V) -> Column:
    return F.date_add(F.add_months(F.make_date(_int(y), F.lit(1), F.lit(1)), _int(m) - 1), _int(d) - 1)


def _timevalue(x: V) -> Column:
    if x.kind != TEXT:
        return number(x) - F.floor(number(x))
    t = F.coalesce(F.try_to_timestamp(x.col, F.lit("HH:mm:ss")), F.try_to_timestamp(x.col, F.lit("HH:mm")))
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400.0


def _weeknum(v: V, kind: V | None = None) -> Column:
    d, monday = day(v), kind is not None and kind.literal == 2.0
    jan = F.trunc(d, "year")
    back = F.weekday(jan) if monday else F.pmod(F.weekday(jan) + 1, F.lit(7))
    return F.floor((F.datediff(d, jan) + back) / 7) + 1


_HMS = lambda h, m, s: F.when(h.between(0, 23) & m.between(0, 59) & s.between(0, 59), (h * 3600 + m * 60 + s) / 86400.0)
SCALARS |= {
    "RAND": lambda: V(F.rand(), NUM), "RANDBETWEEN": numeric(lambda lo, hi: F.when(F.ceil(lo) <= F.floor(hi), F.ceil(lo) + F.floor(F.rand() * (F.floor(hi) - F.ceil(lo) + 1)))),
    "TODAY": lambda: V(F.current_date(), DATE), "NOW": lambda: V(F.current_timestamp(), DATE), "DATE": dated(_date, DATE), "TIME": dated(lambda h, m, s: _HMS(_int(h), _int(m), _int(s))), "DATEVALUE": dated(lambda x: serial(day(x))), "TIMEVALUE": dated(_timevalue),
    "YEAR": dated(lambda x: F.year(day(x))), "MONTH": dated(lambda x: F.month(day(x))), "DAY": dated(lambda x: F.dayofmonth(day(x))), "HOUR": dated(lambda x: F.floor(_time(x) / 3600)), "MINUTE": dated(lambda x: F.floor(F.pmod(_time(x), F.lit(3600)) / 60)), "SECOND": dated(lambda x: F.pmod(_time(x), F.lit(60))),
    "WEEKDAY": dated(lambda x, k=None: {1: F.dayofweek(day(x)), 2: F.weekday(day(x)) + 1, 3: F.weekday(day(x))}[1 if k is None else int(k.literal)]), "WEEKNUM": dated(_weeknum), "ISOWEEKNUM": dated(lambda x: F.weekofyear(day(x))), "DATEDIF": dated(_datedif), "YEARFRAC": dated(_yearfrac),
    "DAYS": dated(lambda b, a: F.datediff(day(b), day(a))), "DAYS360": dated(lambda a, b, k=None: _days360(day(a), day(b), bool(k is not None and k.literal))), "EDATE": dated(lambda a, n: F.add_months(day(a), _int(n)), DATE), "EOMONTH": dated(lambda a, n: F.last_day(F.add_months(day(a), _int(n))), DATE),
    "WORKDAY": dated(lambda a, n, *h: _workday(a, n, [5, 6], list(h)), DATE), "WORKDAY.INTL": dated(lambda a, n, w=None, *h: _workday(a, n, _weekend(w), list(h)), DATE),
    "NETWORKDAYS": dated(lambda a, b, *h: _networkdays(a, b, [5, 6], list(h))), "NETWORKDAYS.INTL": dated(lambda a, b, w=None, *h: _networkdays(a, b, _weekend(w), list(h))),
}


# Bonds on a year of 360 or 365 days


def _basis(v: V | None) -> float:
    return 365.0 if v is not None and int(v.literal) in (1, 3) else 360.0


_bond = lambda f: dated(f)
SCALARS |= {
    "DISC": _bond(lambda s, m, pr, red, b=None: F.try_divide(number(red) - number(pr), number(red)) * _basis(b) / F.datediff(day(m), day(s))), "INTRATE": _bond(lambda s, m, inv, red, b=None: F.try_divide(number(red) - number(inv), number(inv)) * _basis(b) / F.datediff(day(m), day(s))),
    "YIELDDISC": _bond(lambda s, m, pr, red, b=None: F.try_divide(number(red) - number(pr), number(pr)) * _basis(b) / F.datediff(day(m), day(s))), "ACCRINTM": _bond(lambda i, s, r, par=None, b=None: (F.lit(1000.0) if par is None else number(par)) * number(r) * F.datediff(day(s), day(i)) / _basis(b)),
    "ACCRINT": _bond(lambda i, f, s, r, par=None, *k: (F.lit(1000.0) if par is None else number(par)) * number(r) * F.datediff(day(s), day(i)) / _basis(k[1] if len(k) > 1 else None)),
}
