"""Aggregates of the formula language: each takes values over rows and gives an aggregate Column.

Conventions for empty input follow the functions: sums, products, minima and maxima of nothing are 0, an
average of nothing is an error.  Several arguments count as one range, one after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import special
from tabulon.functions.criteria import matches
from tabulon.functions.values import BOOL, DIV_ERROR, NA, NUM, NUM_ERROR, V, is_blank, number, number_a, serial, truth

AGGREGATES: dict[str, Callable[..., V]] = {}
_nought = lambda: F.lit(0.0)


def _out(col: Column, code: str | None = None) -> V:
    return V(col, NUM, F.when(col.isNull(), F.lit(code)) if code else None, aggregate=True)


def aggregate(*names: str):
    def register(f):
        AGGREGATES.update(dict.fromkeys(names, f))
        return f

    return register


def _each(f: Callable[[Column], Column], join: Callable[[Column, Column], Column], args: tuple[V, ...], of=number) -> Column:
    return reduce(join, [f(of(a)) for a in args])


_plus = lambda a, b: F.coalesce(a, _nought()) + F.coalesce(b, _nought())
AGGREGATES |= {
    "SUM": lambda *a: _out(F.coalesce(_each(F.sum, _plus, a), _nought())), "SUMSQ": lambda *a: _out(F.coalesce(_each(lambda x: F.sum(x * x), _plus, a), _nought())), "COUNT": lambda *a: _out(_each(F.count, lambda x, y: x + y, a).cast("double")),
    "COUNTA": lambda *a: _out(reduce(lambda x, y: x + y, [F.count(v.col) if v.err is None else F.count_if(v.col.isNotNull() | v.err.isNotNull()) for v in a]).cast("double")), "COUNTBLANK": lambda *a: _out(reduce(lambda x, y: x + y, [F.count_if(is_blank(v)) for v in a]).cast("double")),
    "MIN": lambda *a: _out(F.coalesce(_each(F.min, F.least, a), _nought())), "MAX": lambda *a: _out(F.coalesce(_each(F.max, F.greatest, a), _nought())), "MINA": lambda *a: _out(F.coalesce(_each(F.min, F.least, a, number_a), _nought())), "MAXA": lambda *a: _out(F.coalesce(_each(F.max, F.greatest, a, number_a), _nought())),
    "AVERAGE": lambda *a: _out(F.try_divide(_each(F.sum, _plus, a), _each(F.count, lambda x, y: x + y, a)), DIV_ERROR), "AVERAGEA": lambda *a: _out(F.try_divide(_each(F.sum, _plus, a, number_a), _each(F.count, lambda x, y: x + y, a, number_a)), DIV_ERROR),
    "PRODUCT": lambda *a: _out(F.coalesce(_each(F.product, lambda x, y: F.coalesce(x, F.lit(1.0)) * F.coalesce(y, F.lit(1.0)), a), _nought())),
    "AND": lambda *a: V(reduce(lambda x, y: x & y, [F.coalesce(F.bool_and(truth(v)), F.lit(True)) for v in a]), BOOL, aggregate=True), "OR": lambda *a: V(reduce(lambda x, y: x | y, [F.coalesce(F.bool_or(truth(v)), F.lit(False)) for v in a]), BOOL, aggregate=True),
    "XOR": lambda *a: V(F.pmod(reduce(lambda x, y: x + y, [F.count_if(truth(v)) for v in a]), F.lit(2)) == 1, BOOL, aggregate=True), "ROWS": lambda a: _out(F.count(F.lit(1)).cast("double")),
}


def _one(f: Callable[..., Column], code: str = DIV_ERROR, of=number):
    return lambda *a: _out(f(of(a[0]), *a[1:]), code)


def _n_least(x: Column, n: int, out: Column) -> Column:
    return F.when(F.count(x) >= n, out)


def _pair(f: Callable[[Column, Column], Column], code: str = DIV_ERROR):
    """Of rows with a number on either side."""

    def run(a: V, b: V) -> V:
        x, y = number(a), number(b)
        both = x.isNotNull() & y.isNotNull()
        return _out(f(F.when(both, x), F.when(both, y)), code)

    return run


def _zeros(f: Callable[[Column, Column], Column]):
    """Of all rows, what is no number being 0."""
    return lambda *a: _out(F.coalesce(F.sum(f(*[F.coalesce(number(v), _nought()) for v in a])), _nought()))


def _moments(x: Column) -> tuple[Column, Column, Column]:
    return F.count(x).cast("double"), F.skewness(x), F.kurtosis(x)


def _skew(x: Column) -> Column:
    n, s, _ = _moments(x)
    return F.when(n >= 3, s * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(x: Column) -> Column:
    n, _, k = _moments(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))


def _steyx(y: Column, x: Column) -> Column:
    n = F.regr_count(y, x)
    return F.when(n >= 3, F.sqrt((F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), 2), F.regr_sxx(y, x))) / (n - 2)))


def _percentile(x: Column, k: Column | float) -> Column:
    return F.percentile(x, k)


def _sorted(x: Column) -> Column:
    """The numbers in order, as (value, count) pairs laid end to end: exact, and for groups that fit a task."""
    return F.sort_array(F.collect_list(x))


def _exc(x: Column, k: Column) -> Column:
    n = F.count(x)
    at = k * (n + 1)
    low = F.floor(at)
    values = _sorted(x)
    a, b = F.try_element_at(values, low.cast("int")), F.try_element_at(values, (low + 1).cast("int"))
    return F.when((at >= 1) & (at <= n), a + F.coalesce((b - a) * (at - low), _nought()))


def _nth(ascending: bool):
    def run(a: V, k: V) -> V:
        values = F.sort_array(F.collect_list(number(a)), ascending)
        i = F.lit(int(k.literal))
        return _out(F.when((i >= 1) & (i <= F.size(values)), F.try_element_at(values, i)), NUM_ERROR)

    return run


def _trimmean(x: Column, part: V) -> Column:
    values = _sorted(x)
    cut = F.floor(F.floor(F.size(values) * F.lit(part.literal)) / 2).cast("int")
    kept = F.slice(values, cut + 1, F.size(values) - 2 * cut)
    return F.when(F.size(values) > 0, F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(kept))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, not at every use of it within a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _avedev(x: Column) -> Column:
    values = F.collect_list(x)
    return F.when(F.count(x) > 0, _let(F.avg(x), lambda m: F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - m))) / F.count(x))


def _positive(f: Callable[[Column], Column]):
    return lambda x: F.when(F.min(x) > 0, f(x))


AGGREGATES |= {
    **dict.fromkeys(("STDEV", "STDEV.S"), _one(lambda x: _n_least(x, 2, F.stddev_samp(x)))), **dict.fromkeys(("STDEVP", "STDEV.P"), _one(F.stddev_pop)), **dict.fromkeys(("VAR", "VAR.S"), _one(lambda x: _n_least(x, 2, F.var_samp(x)))), **dict.fromkeys(("VARP", "VAR.P"), _one(F.var_pop)),
    "STDEVA": _one(lambda x: _n_least(x, 2, F.stddev_samp(x)), of=number_a), "STDEVPA": _one(F.stddev_pop, of=number_a), "VARA": _one(lambda x: _n_least(x, 2, F.var_samp(x)), of=number_a), "VARPA": _one(F.var_pop, of=number_a),
    "DEVSQ": _one(lambda x: F.var_pop(x) * F.count(x)), "AVEDEV": _one(_avedev), "MEDIAN": _one(F.median, NUM_ERROR), "GEOMEAN": _one(_positive(lambda x: F.exp(F.avg(F.log(x)))), NUM_ERROR), "HARMEAN": _one(_positive(lambda x: F.count(x) / F.sum(F.try_divide(F.lit(1.0), x))), NUM_ERROR),
    "MODE.SNGL": _one(lambda x: F.when(F.count(x) > F.count_distinct(x), F.mode(x, True)), NA), "SKEW": _one(_skew), "SKEW.P": _one(lambda x: F.when(F.var_pop(x) == 0, _nought()).otherwise(F.skewness(x))), "KURT": _one(_kurt), "TRIMMEAN": _one(_trimmean, NUM_ERROR),
    **dict.fromkeys(("PERCENTILE", "PERCENTILE.INC"), _one(lambda x, k: _percentile(x, k.literal), NUM_ERROR)), "PERCENTILE.EXC": _one(lambda x, k: _exc(x, F.lit(k.literal)), NUM_ERROR),
    **dict.fromkeys(("QUARTILE", "QUARTILE.INC"), _one(lambda x, q: _percentile(x, q.literal / 4), NUM_ERROR)), "QUARTILE.EXC": _one(lambda x, q: _exc(x, F.lit(q.literal / 4)), NUM_ERROR), "LARGE": _nth(False), "SMALL": _nth(True),
    **dict.fromkeys(("CORREL", "PEARSON"), _pair(F.corr)), "RSQ": _pair(lambda y, x: F.pow(F.corr(y, x), 2)), **dict.fromkeys(("COVAR", "COVARIANCE.P"), _pair(F.covar_pop)), "COVARIANCE.S": _pair(lambda x, y: F.when(F.count(x) >= 2, F.covar_samp(x, y))),
    "SLOPE": _pair(F.regr_slope), "INTERCEPT": _pair(F.regr_intercept), "STEYX": _pair(_steyx), "SUMPRODUCT": _zeros(lambda *x: reduce(lambda a, b: a * b, x)), "SUMX2MY2": _zeros(lambda x, y: x * x - y * y), "SUMX2PY2": _zeros(lambda x, y: x * x + y * y), "SUMXMY2": _zeros(lambda x, y: (x - y) * (x - y)),
    "FVSCHEDULE": lambda p, r: _out(number(p) * F.product(1 + number(r)) if not p.literal else F.lit(p.literal) * F.product(1 + number(r))), "PROB": lambda x, p, lo, hi=None: _out(F.coalesce(F.sum(F.when(number(x).between(min(lo.literal, (hi or lo).literal), max(lo.literal, (hi or lo).literal)), number(p))), _nought())),
}


# Criteria


def _crit(pairs: tuple[V, ...]) -> Column:
    return reduce(lambda a, b: a & b, [matches(r, c.literal) for r, c in zip(pairs[::2], pairs[1::2], strict=True)])


def _if(f: Callable[[Column], Column], code: str | None):
    def run(r: V, c: V, of: V | None = None) -> V:
        return _out(f(F.when(matches(r, c.literal), number(of or r))), code)

    return run


def _ifs(f: Callable[[Column], Column], code: str | None):
    return lambda of, *pairs: _out(f(F.when(_crit(pairs), number(of))), code)


_or0 = lambda f: lambda x: F.coalesce(f(x), _nought())
AGGREGATES |= {
    "SUMIF": _if(_or0(F.sum), None), "AVERAGEIF": _if(F.avg, DIV_ERROR), "COUNTIF": lambda r, c: _out(F.count_if(matches(r, c.literal)).cast("double")), "SUMIFS": _ifs(_or0(F.sum), None), "AVERAGEIFS": _ifs(F.avg, DIV_ERROR),
    "MINIFS": _ifs(_or0(F.min), None), "MAXIFS": _ifs(_or0(F.max), None), "COUNTIFS": lambda *pairs: _out(F.count_if(_crit(pairs)).cast("double")),
}


# Over ordered values: rows are put in order by a key


def _ordered(value: V, key: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(number(value).isNotNull(), F.struct(key.alias("k"), number(value).alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def npv(rate: float, value: V, key: Column) -> Column:
    """Rows numbered 1, 2, ... by the key, each discounted by its number."""
    return F.aggregate(F.transform(_ordered(value, key), lambda v, i: v / F.pow(F.lit(1 + rate), i + 1)), F.lit(0.0), lambda s, v: s + v)


def _serial(dates: V) -> Column:
    return serial(dates.col) if dates.kind != NUM else dates.col


def _dated(value: V, dates: V) -> Column:
    """Dates and values in order, without rows that lack either."""
    d, v = _serial(dates), number(value)
    return F.array_sort(F.collect_list(F.when(d.isNotNull() & v.isNotNull(), F.struct(d.cast("double").alias("d"), v.alias("v")))))


def xnpv(rate: float, value: V, dates: V) -> Column:
    """Discounted by days since the first date over 365."""
    d, pairs = _serial(dates), _dated(value, dates)
    return _let(F.min(d), lambda first: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["v"] / F.pow(F.lit(1 + rate), (p["d"] - first) / 365.0)))


def irr(value: V, key: Column, guess: float = 0.1) -> Column:
    @F.pandas_udf("double")
    def run(values):
        import pandas as pd

        return pd.Series(special.rates(values, [range(len(v)) for v in values], guess))

    return run(_ordered(value, key))


def xirr(value: V, dates: V, guess: float = 0.1) -> Column:
    @F.pandas_udf("double")
    def run(values, days):
        import pandas as pd

        return pd.Series(special.rates(values, [(d - d[:1]) / 365 for d in days], guess))

    pairs = _dated(value, dates)
    return run(F.transform(pairs, lambda p: p["v"]), F.transform(pairs, lambda p: p["d"]))


def mirr(value: V, key: Column, finance: float, reinvest: float) -> Column:
    """((-sum of positive v / (1 + rr)^i * (1 + rr)^(n - 1)) / (sum of negative v / (1 + fr)^i * (1 + fr)))^(1 / (n - 1)) - 1."""
    v = _ordered(value, key)
    part = lambda r, sign: F.aggregate(F.transform(v, lambda x, i: F.when(x * sign > 0, x / F.pow(F.lit(1 + r), i.cast("double"))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    n = F.size(v)
    return F.pow(F.try_divide(-part(reinvest, 1) * F.pow(F.lit(1 + reinvest), n - 1), part(finance, -1) * (1 + finance)), F.try_divide(F.lit(1.0), n - 1)) - 1


def seriessum(x: Column, n: float, m: float, coefficient: V, key: Column) -> Column:
    return F.aggregate(F.transform(_ordered(coefficient, key), lambda c, i: c * F.pow(x, F.lit(float(n)) + i * F.lit(float(m)))), F.lit(0.0), lambda s, v: s + v)


_guess = lambda g: 0.1 if g is None else float(g.literal)
#: Functions that also take, first, the key that puts the rows in order.
ORDERED = ("NPV", "XNPV", "IRR", "XIRR", "MIRR", "SERIESSUM")
AGGREGATES |= {
    "NPV": lambda key, rate, value: _out(npv(rate.literal, value, key), NUM_ERROR), "XNPV": lambda key, rate, value, dates: _out(xnpv(rate.literal, value, dates), NUM_ERROR),
    "IRR": lambda key, value, guess=None: _out(irr(value, key, _guess(guess)), NUM_ERROR), "XIRR": lambda key, value, dates, guess=None: _out(xirr(value, dates, _guess(guess)), NUM_ERROR),
    "MIRR": lambda key, value, finance, reinvest: _out(mirr(value, key, finance.literal, reinvest.literal), NUM_ERROR), "SERIESSUM": lambda key, x, n, m, value: _out(seriessum(F.lit(x.literal), n.literal, m.literal, value, key), NUM_ERROR),
}


# Tests


def _tail(f: Callable, n: int):
    return special.udf(f, "double", n)


AGGREGATES |= {
    "Z.TEST": lambda a, x, s=None: _out(_tail(lambda z: 1 - special._N.cdf(z), 1)(F.try_divide(F.avg(number(a)) - x.literal, (F.stddev_samp(number(a)) if s is None else F.lit(s.literal)) / F.sqrt(F.nullif(F.count(number(a)), F.lit(0))))), NUM_ERROR),
    "F.TEST": lambda a, b: _out(_tail(lambda va, vb, na, nb: 2 * min(p := special.f_cdf(va / vb, na - 1, nb - 1), 1 - p), 4)(F.var_samp(number(a)), F.nullif(F.var_samp(number(b)), F.lit(0.0)), F.count(number(a)).cast("double"), F.count(number(b)).cast("double")), NUM_ERROR),
    "CHISQ.TEST": lambda a, e: _out(_tail(lambda x, n: 1 - special.gamma_p((n - 1) / 2, x / 2), 2)(F.when(F.count_if(F.coalesce(number(e), F.lit(0.0)) == 0) == 0, F.sum(F.try_divide(F.pow(F.coalesce(number(a), F.lit(0.0)) - number(e), 2), number(e)))), F.count(number(a)).cast("double")), NUM_ERROR),
}


@aggregate("T.TEST", "TTEST")
def t_test(a: V, b: V, tails: V, kind: V) -> V:
    x, y, k = number(a), number(b), int(kind.literal)
    q = F.try_divide
    na, nb, va, vb = F.count(x).cast("double"), F.count(y).cast("double"), F.var_samp(x), F.var_samp(y)
    if k == 1:
        d = F.when(x.isNotNull() & y.isNotNull(), x - y)
        t, v = q(F.avg(d), q(F.stddev_samp(d), F.sqrt(F.count(d)))), F.count(d).cast("double") - 1
    elif k == 2:
        pooled = q((na - 1) * va + (nb - 1) * vb, na + nb - 2)
        t, v = q(F.avg(x) - F.avg(y), F.sqrt(pooled * (q(F.lit(1.0), na) + q(F.lit(1.0), nb)))), na + nb - 2
    else:
        t = q(F.avg(x) - F.avg(y), F.sqrt(q(va, na) + q(vb, nb)))
        v = q(F.pow(q(va, na) + q(vb, nb), 2), q(F.pow(q(va, na), 2), na - 1) + q(F.pow(q(vb, nb), 2), nb - 1))
    return _out(_tail(lambda t, v: 1 - special.t_cdf(abs(t), v), 2)(t, v) * tails.literal, NUM_ERROR)


AGGREGATES |= {"ZTEST": AGGREGATES["Z.TEST"], "FTEST": AGGREGATES["F.TEST"], "CHITEST": AGGREGATES["CHISQ.TEST"]}

