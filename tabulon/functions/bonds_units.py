"""Bonds by numeric solution, depreciation over part periods, and unit conversion."""

from __future__ import annotations

import math
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import special
from tabulon.functions.scalar import SCALARS, dated, day, folded, numeric
from tabulon.functions.values import NA, NUM, TEXT, V, first_error, number, number_arg, text

#: Units by kind, as multiples of the first of each kind.
UNITS = {
    "weight": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lbm": 453.59237, "ozm": 28.349523125},
    "distance": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344},
    "time": {"sec": 1.0, "mn": 60.0, "hr": 3600.0, "day": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "atm": 101325.0, "mmHg": 133.322},
    "force": {"N": 1.0, "dyn": 1e-5, "lbf": 4.4482216152605},
    "energy": {"J": 1.0, "e": 1e-7, "cal": 4.1868, "BTU": 1055.05585262},
    "power": {"W": 1.0, "HP": 745.69987158227},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "gal": 3.785411784, "qt": 0.946352946, "pt": 0.473176473},
}
#: Temperatures in kelvin as (factor, offset added before).
TEMPERATURES = {"K": (1.0, 0.0), "C": (1.0, 273.15), "F": (5 / 9, 459.67)}


def convert(x: V, source: V, target: V) -> V:
    """Between units of one kind; units that are columns are looked up row by row in the fixed table."""
    n, a, b = number_arg(x), source.literal, target.literal
    if a is None or b is None:
        return _convert_columns(n, text(source), text(target), first_error(source.err, target.err))
    if a in TEMPERATURES and b in TEMPERATURES:
        (f, p), (g, q) = TEMPERATURES[a], TEMPERATURES[b]
        return V((n.col + p) * f / g - q, NUM, n.err)
    kind = next((k for k in UNITS.values() if a in k and b in k), None)
    if kind is None:
        return V(F.lit(None).cast("double"), NUM, first_error(n.err, F.lit(NA)))
    return V(n.col * kind[a] / kind[b], NUM, n.err)


def _convert_columns(n: V, source: Column, target: Column, err: Column | None) -> V:
    every = {u: (k, f, 0.0) for k, units in UNITS.items() for u, f in units.items()} | {u: ("temperature", f, p) for u, (f, p) in TEMPERATURES.items()}
    table = F.create_map(*[c for u, (k, f, p) in every.items() for c in (F.lit(u), F.struct(F.lit(k).alias("k"), F.lit(f).alias("f"), F.lit(p).alias("p")))])
    a, b = F.try_element_at(table, source), F.try_element_at(table, target)
    out = F.when(a["k"] == b["k"], (n.col + a["p"]) * a["f"] / b["f"] - b["p"])
    return V(out, NUM, first_error(n.err, err, F.when(out.isNull(), F.lit(NA))), strict=True)


def _periods(days: float, frequency: float, year: float) -> int:
    return max(1, math.floor(days / year * frequency + 0.5))


def bond_yield(days: float, rate: float, price: float, redemption: float, frequency: float, year: float) -> float | None:
    n, coupon = _periods(days, frequency, year), rate * 100 / frequency
    r = special.irr([-price, *[coupon] * (n - 1), coupon + redemption], rate / frequency)
    return None if r is None else r * frequency


def duration(days: float, rate: float, yld: float, frequency: float, year: float) -> float | None:
    """Macaulay: the mean time of the discounted payments."""
    n, coupon = _periods(days, frequency, year), rate * 100 / frequency
    worth = [(coupon + 100 * (k == n)) / (1 + yld / frequency) ** k for k in range(1, n + 1)]
    return sum(k / frequency * w for k, w in enumerate(worth, 1)) / sum(worth) if sum(worth) else None


def declining(cost: float, salvage: float, life: float, start: float, end: float, factor: float = 2.0, no_switch: float = 0.0) -> float | None:
    """Depreciation between two times: declining balance, or straight line over what is left where that is more
    and switching is allowed; never below the salvage value."""
    if cost < 0 or life <= 0 or start < 0 or end < start or end > life or factor <= 0:
        return None
    book = cost
    total = 0.0
    for i in range(math.ceil(end)):
        step = min(book * factor / life, book - salvage)
        if not no_switch:
            step = max(step, (book - salvage) / (life - i))
        step = max(step, 0.0)
        total += step * max(0.0, min(end, i + 1) - max(start, i))
        book -= step
    return total


def _year(v: V | None, long_basis=(1, 3, 4)) -> float:
    return 365.0 if v is not None and int(v.literal) in long_basis else 360.0


def _days(a: V, b: V):
    return F.datediff(day(b), day(a)).cast("double")


def _solve(f, *args):
    return special.udf(f, "double", len(args))(*args)


def _date(v: V) -> date | None:
    for mask in ("%Y-%m-%d", "%m/%d/%Y"):
        try:
            return datetime.strptime(str(v.literal), mask).date()
        except ValueError:
            continue
    return None


def _bond(f, n: int):
    """A function of two dates, n numbers and a basis, through f of (days, numbers, year); once on the driver where
    all are literals."""

    def run(settlement: V, maturity: V, *rest: V) -> V:
        numbers, year = rest[:n], _year(rest[n] if len(rest) > n else None)
        a, b = (_date(v) if v.kind == TEXT and v.literal is not None else None for v in (settlement, maturity))
        if a and b and all(isinstance(x.literal, float) for x in numbers):
            return folded(f, float((b - a).days), *[x.literal for x in numbers], year)
        return dated(lambda *_: _solve(f, _days(settlement, maturity), *map(number, numbers), F.lit(year)))(settlement, maturity, *numbers)

    run.arity = (2 + n, 3 + n)
    return run


def _declining(cost, salvage, life, start, end, factor=None, no_switch=None):
    """:func:`declining` as a fold over the periods."""
    factor, no_switch = (F.lit(x) if c is None else c for x, c in ((2.0, factor), (0.0, no_switch)))

    def each(a, i):
        step = F.least(a["book"] * factor / life, a["book"] - salvage)
        step = F.when(no_switch != 0, step).otherwise(F.greatest(step, (a["book"] - salvage) / (life - (i - 1))))
        step = F.greatest(step, F.lit(0.0))
        share = F.greatest(F.lit(0.0), F.least(end, i.cast("double")) - F.greatest(start, (i - 1).cast("double")))
        return F.struct((a["book"] - step).alias("book"), (a["total"] + step * share).alias("total"))

    right = (cost >= 0) & (life > 0) & (start >= 0) & (end >= start) & (end <= life) & (factor > 0)
    periods = F.when(right & (end > 0), F.sequence(F.lit(1), F.ceil(end).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(right, F.aggregate(periods, F.struct(cost.alias("book"), F.lit(0.0).alias("total")), each, lambda a: a["total"]))


SCALARS |= {
    "CONVERT": convert,
    "YIELD": _bond(bond_yield, 4), "DURATION": _bond(duration, 3), "VDB": numeric(_declining, flags=True),
    "YIELDMAT": dated(lambda s, m, i, r, p, b=None: ((1 + _days(i, m) / _year(b, (1, 3)) * number(r)) * 100 / (number(p) + 100 * _days(i, s) / _year(b, (1, 3)) * number(r)) - 1) / (_days(s, m) / _year(b, (1, 3)))),
}
