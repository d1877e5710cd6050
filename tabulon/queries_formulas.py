"""Queries of lookups, ranks, database functions and cash flows inside formulas, and of distributions against series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.plans import formula
from tabulon.queries import _sql_column, groups_query, query, read, rounded, rows_query


def _nations(spark: SparkSession, sf_dir: str) -> formula.Table:
    n = read(spark, sf_dir, "nation")
    return formula.Table(n.select((F.col("n_nationkey") + 1).alias("pos"), "n_nationkey", "n_name", "n_regionkey"), "pos")


#: Result: (formula, SQL, kind) over customers c with nation n joined by key.
_LOOKUPS = {
    "f_vlookup": ("=VLOOKUP(c_nationkey, Nations, 2)", "n.n_name", "text"), "f_vrange": ("=VLOOKUP(c_nationkey, Nations[[n_nationkey]:[n_regionkey]], 3, FALSE)", "n.n_regionkey"), "f_xlookup": ('=XLOOKUP(c_nationkey, Nations[n_nationkey], Nations[n_name], "none")', "n.n_name", "text"),
    "f_missing": ('=XLOOKUP(c_nationkey + 15, Nations[n_nationkey], Nations[n_name], "none")', "coalesce((SELECT n_name FROM nation WHERE n_nationkey = c_nationkey + 15), 'none')", "text"), "f_iferror": ("=IFERROR(VLOOKUP(c_nationkey + 15, Nations, 3), -1)", "coalesce((SELECT n_regionkey FROM nation WHERE n_nationkey = c_nationkey + 15), -1)"),
    "f_match": ("=MATCH(MOD(c_nationkey, 5), Nations[n_regionkey], 0)", "(SELECT min(n_nationkey) + 1 FROM nation WHERE n_regionkey = c_nationkey % 5)"), "f_xmatch": ("=XMATCH(n, Nations[n_name])", "n.n_nationkey + 1"),
    "f_index": ("=INDEX(Nations[n_name], MATCH(c_nationkey, Nations[n_nationkey], 0))", "n.n_name", "text"), "f_index2": ("=INDEX(Nations, 3, 2)", "(SELECT n_name FROM nation WHERE n_nationkey = 2)", "text"), "f_hlookup": ('=HLOOKUP("n_name", Nations, 4)', "(SELECT n_name FROM nation WHERE n_nationkey = 2)", "text"),
    "f_hheader": ('=HLOOKUP("N_NAME", Nations, 1)', "NULL::VARCHAR", "text"), "f_header": ("=Nations[[#Headers],[n_name]]", "'n_name'", "text"), "f_columns": ("=COLUMNS(Nations) + COLUMNS(Nations[n_name])", "4"), "f_column": ("=COLUMN(c_nationkey) + COLUMN(Nations[n_regionkey])", "c_col + 3"),
    "f_sheets": ('=SHEETS() + SHEET("Nations")', "4"), "f_row": ("=ROW() * 2", "c_custkey * 2"), "f_thisrow": ("=[@c_custkey] + Customers[[#This Row],[c_custkey]]", "2 * c_custkey"), "f_between": ("=IF(RANDBETWEEN(3, 5) >= 3, 1, 0) + INT(RAND())", "1"),
}


@query("SELECT c_custkey, " + ", ".join(_sql_column(k, v) for k, v in _LOOKUPS.items()).replace("c_col", "2") + " FROM (SELECT c_custkey, c_nationkey FROM customer) c JOIN nation n ON c_nationkey = n.n_nationkey")
def formula_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    named = {"n": "=VLOOKUP(c_nationkey, Nations, 2)"}
    out = formula.calculate(c, {k: v[0] for k, v in _LOOKUPS.items()}, named, tables={"Nations": _nations(spark, sf_dir)}, position="c_custkey")
    return rounded(out.select("c_custkey", *_LOOKUPS), list(_LOOKUPS))


_RANKS = {
    "f_rank": ("=RANK(o_totalprice, [o_totalprice])", "rank() OVER (ORDER BY o_totalprice DESC)"), "f_rank_eq": ("=RANK.EQ(o_totalprice, [o_totalprice], 1)", "rank() OVER (ORDER BY o_totalprice)"),
    "f_rank_avg": ("=RANK.AVG(o_custkey, [o_custkey])", "rank() OVER (ORDER BY o_custkey DESC) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0"), "f_percent": ("=PERCENTRANK([o_totalprice], o_totalprice)", "floor((rank() OVER (ORDER BY o_totalprice) - 1) / (count(*) OVER () - 1.0::DOUBLE) * 1000 + 1e-9) / 1000"),
    "f_inc": ("=PERCENTRANK.INC([o_custkey], o_custkey, 2)", "floor((rank() OVER (ORDER BY o_custkey) - 1) / (count(*) OVER () - 1.0::DOUBLE) * 100 + 1e-9) / 100"), "f_exc": ("=PERCENTRANK.EXC([o_totalprice], o_totalprice)", "floor(rank() OVER (ORDER BY o_totalprice) / (count(*) OVER () + 1.0::DOUBLE) * 1000 + 1e-9) / 1000"),
}
rows_query("formula_ranks", "orders", ["o_orderkey"], _RANKS)

_CRITERIA = [{"l_quantity": ">=40", "l_linestatus": "F"}, {"l_tax": "0.02", "l_returnflag": "<>R"}]
_MET = "FILTER (WHERE (l_quantity >= 40 AND l_linestatus = 'F') OR (l_tax = 0.02 AND l_returnflag <> 'R'))"
_DATABASE = {
    "f_dsum": ('=DSUM([#All], "l_extendedprice", lines)', "sum(l_extendedprice)"), "f_daverage": ('=DAVERAGE([#All], "l_quantity", lines)', "avg(l_quantity)"), "f_dcount": ('=DCOUNT([#All], "l_returnflag", lines)', "0 * count(*)"), "f_dcounta": ('=DCOUNTA([#All], "l_returnflag", lines)', "count(l_returnflag)"),
    "f_dmax": ('=DMAX([#All], "l_discount", lines)', "max(l_discount)"), "f_dmin": ('=DMIN([#All], "l_extendedprice", lines)', "min(l_extendedprice)"), "f_dstdev": ('=DSTDEV([#All], "l_quantity", lines)', "stddev_samp(l_quantity)"), "f_dstdevp": ('=DSTDEVP([#All], "l_quantity", lines)', "stddev_pop(l_quantity)"),
    "f_dvar": ('=DVAR([#All], "l_quantity", lines)', "var_samp(l_quantity)"), "f_dvarp": ('=DVARP([#All], "l_quantity", lines)', "var_pop(l_quantity)"), "f_dproduct": ('=DPRODUCT([#All], "l_linenumber", few)', None), "f_dget": ('=IFERROR(DGET([#All], "l_quantity", lines), -1)', None),
}


@query(
    "SELECT l_returnflag, " + ", ".join(f"round(CAST({s} {_MET} AS DOUBLE), 6) + 0.0 AS {k}" for k, (_, s) in _DATABASE.items() if s)
    + ", round(CAST(product(l_linenumber) FILTER (WHERE l_orderkey < 3) AS DOUBLE), 6) + 0.0 AS f_dproduct, -1.0::DOUBLE AS f_dget FROM lineitem GROUP BY 1"
)
def formula_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"lines": _CRITERIA, "few": [{"l_orderkey": "<3"}]}
    return rounded(formula.summarize(read(spark, sf_dir, "lineitem"), {k: v[0] for k, v in _DATABASE.items()}, ["l_returnflag"], names), list(_DATABASE))


# Cash flows: the first order of a customer is paid out, the others come in; for XIRR those of the first day

_FLOWS = "(SELECT o_custkey, o_orderkey, row_number() OVER w AS i, o_orderdate::DATE AS d, min(o_orderdate::DATE) OVER (PARTITION BY o_custkey) AS d0, CASE WHEN row_number() OVER w = 1 THEN -3 * o_totalprice ELSE o_totalprice END AS v, o_totalprice AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.min(F.to_date("o_orderdate")).alias("d0"))
    signed = lambda paid: F.when(paid, -3 * F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    day = F.to_date("o_orderdate")
    return o.join(first, "o_custkey").select("o_custkey", "o_orderkey", day.alias("d"), signed(F.col("o_orderkey") == F.col("first")).alias("v"), signed(day == F.col("d0")).alias("vx"))


@query(
    f"SELECT o_custkey, round(sum(v / pow(1.07, i)), 3) AS npv, round(sum(v / pow(1.07, date_diff('day', d0, d) / 365.0::DOUBLE)), 3) AS xnpv, round(sum(v * pow(0.5, 1 + 2 * (i - 1))), 3) AS series, "
    "CASE WHEN count(*) > 1 THEN 0.0::DOUBLE END AS irr_residual, round(CASE WHEN count(*) > 1 THEN pow(sum(CASE WHEN v > 0 THEN v / pow(1.12, i - 1) END) * pow(1.12, count(*) - 1) / (-sum(CASE WHEN v < 0 THEN v / pow(1.1, i - 1) END) * 1.1), 1.0::DOUBLE / (count(*) - 1)) - 1 END, 6) AS mirr, "
    f"CASE WHEN sum((CASE WHEN d = d0 THEN -3 ELSE 1 END) * p / pow(0.001, date_diff('day', d0, d) / 365.0::DOUBLE)) > 0 AND sum((CASE WHEN d = d0 THEN -3 ELSE 1 END) * p / pow(10001, date_diff('day', d0, d) / 365.0::DOUBLE)) < 0 THEN 0.0::DOUBLE END AS xirr_residual FROM {_FLOWS} GROUP BY 1"
)
def formula_cashflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IRR and XIRR are judged by what is left of the flows at the rate found, relative to their size."""
    f = _flows(spark, sf_dir)
    sums = {"npv": "=NPV(0.07, v)", "xnpv": "=XNPV(0.07, v, d)", "series": "=SERIESSUM(0.5, 1, 2, v)", "irr": "=IRR(v)", "mirr": "=MIRR(v, 0.1, 0.12)", "xirr": "=XIRR(vx, d)"}
    out = formula.summarize(f, sums, ["o_custkey"], order="o_orderkey")
    seen = f.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "v", "d", "vx"))).alias("flows"), F.sum(F.abs("v")).alias("size"), F.min("d").alias("d0"))
    joined = out.join(seen, "o_custkey")
    left = F.aggregate(F.transform("flows", lambda p, i: p["v"] / F.pow(1 + F.col("irr"), i)), F.lit(0.0), lambda s, v: s + v)
    # the first flow's day counts as day 0 of XIRR's, so the flows go by date there
    by_date = F.array_sort(F.transform("flows", lambda p: F.struct(p["d"].alias("d"), p["vx"].alias("v"))))
    worth = lambda r: F.aggregate(F.transform(by_date, lambda p: p["v"] / F.pow(1 + r, F.datediff(p["d"], F.col("d0")) / 365.0)), F.lit(0.0), lambda s, v: s + v)
    # rates within -0.999 and 10,000 are what is sought
    within = (worth(F.lit(-0.999)) > 0) & (worth(F.lit(10_000.0)) < 0)
    done = joined.withColumn("irr_residual", left / F.col("size")).withColumn("xirr_residual", F.when(within, worth(F.col("xirr")) / F.col("size")))
    names = ["npv", "xnpv", "series", "mirr", "irr_residual", "xirr_residual"]
    return rounded(rounded(done.select("o_custkey", *names), ["mirr", "irr_residual", "xirr_residual"]), ["npv", "xnpv", "series"], 3)


@query("SELECT n_name, r_name, r.c FROM nation JOIN (SELECT r_regionkey, r_name, 2 AS c FROM region) r ON n_regionkey = r_regionkey")
def lookup_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region table laid out in columns, looked up by header through HLOOKUP."""
    r = read(spark, sf_dir, "region")
    wide = r.select(F.lit(1).alias("pos"), F.concat(F.lit("k"), "r_regionkey").alias("h"), "r_name").groupBy("pos").pivot("h", [f"k{i}" for i in range(5)]).agg(F.max("r_name"))
    n = read(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    return formula.calculate(n, {"r_name": '=HLOOKUP(CONCAT("k", n_regionkey), Regions, 2)', "c": "=2"}, tables={"Regions": formula.Table(wide, "pos")}).select("n_name", "r_name", F.col("c").cast("int").alias("c"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def join_anti_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.operators import tables as op

    some = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return op.lacks_match(read(spark, sf_dir, "customer"), "c_custkey", some, "o_custkey").select("c_custkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
def sort_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the order of names whatever their case: rows of a first letter are numbered apart."""
    from tabulon.operators import tables as op

    p = read(spark, sf_dir, "part").select("p_partkey", "p_name").withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return op.numbered(p, [op.sort_key(p, "p_name"), op.sort_key(p, "p_partkey")], F.lower(F.substring("p_name", 1, 1)), "place").select("p_partkey", "place")


rows_query("units", "part", ["p_partkey"], {
    "f_column": ('=IFERROR(CONVERT(p_size, CHOOSE(MOD(p_size, 3) + 1, "km", "mi", "F"), "m"), -1)', "CASE p_size % 3 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1609.344 ELSE -1 END"), "f_warm": ('=CONVERT(p_size, "C", IF(p_size > 25, "F", "K"))', "CASE WHEN p_size > 25 THEN p_size * 1.8 + 32 ELSE p_size + 273.15 END"),
    "f_weight": ('=CONVERT(p_size, "lbm", "kg")', "p_size * 0.45359237"), "f_time": ('=CONVERT(p_size, "yr", "day")', "p_size * 365.25"), "f_none": ('=IFNA(CONVERT(p_size, "kg", "sec"), 0)', "0"),
})

# Distributions against series that DuckDB adds up

_SUM = "list_sum(list_transform(range(0, {n}), lambda k: {t}))"


def _phi(z: str) -> str:
    """0.5 + density times z + z^3 / 3 + z^5 / (3 5) + ..., z within 8."""
    z = f"least(greatest({z}, -8), 8)"
    term = f"exp((2 * k + 1) * ln(greatest(abs({z}), 1e-12)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {_SUM.format(n=250, t=term)})"


def _gamma(a: str, x: str) -> str:
    return _SUM.format(n=400, t=f"exp(({a} + k) * ln({x}) - ({x}) - lgamma({a} + k + 1))")


def _beta(a: str, b: str, x: str) -> str:
    """The lower half by a series of positive terms, the upper by symmetry."""

    def series(a: str, b: str, x: str, rest: str) -> str:
        return _SUM.format(n=200, t=f"exp(lgamma({a} + {b} + k) - lgamma({a} + 1 + k) - lgamma({b}) + ({a} + k) * ln(greatest({x}, 1e-300)) + ({b}) * ln(greatest({rest}, 1e-300)))")

    return f"(CASE WHEN {x} <= 0.5 THEN {series(a, b, x, f'(1 - {x})')} ELSE 1 - {series(b, a, f'(1 - {x})', x)} END)"


def _comb(n: str, k: str) -> str:
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


def _binom(k: str, n: str, p: str) -> str:
    return f"{_comb(n, k)} * pow({p}, {k}) * pow(1 - {p}, {n} - ({k}))"


_S, _P = "p_size::DOUBLE", "(p_size / 60.0::DOUBLE)"
_TCDF = "(CASE WHEN {t} > 0 THEN 1 - {h} ELSE {h} END)"


def _t(t: str, v: str) -> str:
    return _TCDF.format(t=f"({t})", h=f"0.5 * {_beta(f'({v} / 2)', '0.5', f'({v} / ({v} + ({t}) * ({t})))')}")


_Z = "((p_size - 25) / 10.0::DOUBLE)"
rows_query("distributions_normal", "part", ["p_partkey"], {
    "f_normdist": ("=NORMDIST(p_size, 25, 10, TRUE)", _phi(_Z)), "f_norm_dist": ("=NORM.DIST(p_size, 25, 10, TRUE)", _phi(_Z)), "f_normsdist": ("=NORMSDIST((p_size - 25) / 10)", _phi(_Z)), "f_gauss": ("=GAUSS((p_size - 25) / 10)", f"{_phi(_Z)} - 0.5"), "f_erf": ("=ERF((p_size - 25) / 10)", f"2 * {_phi(f'({_Z} * sqrt(2))')} - 1"),
    "f_erfc": ("=ERFC((p_size - 25) / 10)", f"2 - 2 * {_phi(f'({_Z} * sqrt(2))')}"), "f_norminv": ("=NORMINV(NORMDIST(p_size, 25, 10, TRUE), 25, 10)", "p_size"), "f_norm_inv": ("=NORM.INV(NORMSDIST((p_size - 25) / 10), 0, 1)", _Z), "f_normsinv": ("=NORMSINV(NORMSDIST((p_size - 25) / 10))", _Z),
    "f_lognorm": ("=LOGNORM.DIST(p_size, 2, 1.5, TRUE)", _phi(f"((ln({_S}) - 2) / 1.5)")), "f_lognormdist": ("=LOGNORMDIST(p_size, 2, 1.5, FALSE)", f"exp(-pow((ln({_S}) - 2) / 1.5, 2) / 2) / (p_size * 1.5 * sqrt(2 * pi()))"), "f_loginv": ("=LOGINV(LOGNORMDIST(p_size, 2, 1.5, TRUE), 2, 1.5)", "p_size"),
    "f_confidence": ("=NORMSDIST(CONFIDENCE(p_size / 60, 3, 16) * 4 / 3)", f"1 - {_P} / 2"), "f_confidence_norm": ("=NORM.S.DIST(CONFIDENCE.NORM(p_size / 60, 3, 16) * 4 / 3, TRUE)", f"1 - {_P} / 2"), "f_confidence_t": ("=T.DIST(CONFIDENCE.T(p_size / 60, 3, 16) * 4 / 3, 15, TRUE)", f"1 - {_P} / 2"),
})
rows_query("distributions_counts", "part", ["p_partkey"], {
    "f_binomdist": ("=BINOMDIST(MOD(p_size, 9), 12, 0.3, TRUE)", _SUM.format(n=13, t=f"CASE WHEN k <= p_size % 9 THEN {_binom('k', '12', '0.3')} ELSE 0 END")), "f_binom_range": ("=BINOM.DIST.RANGE(12, 0.3, 2, 2 + MOD(p_size, 9))", _SUM.format(n=13, t=f"CASE WHEN k BETWEEN 2 AND 2 + p_size % 9 THEN {_binom('k', '12', '0.3')} ELSE 0 END")),
    "f_binom_inv": ("=BINOM.INV(20, 0.4, p_size / 60)", f"len(list_filter(range(0, 21), lambda m: list_sum(list_transform(range(0, 21), lambda k: CASE WHEN k <= m THEN {_binom('k', '20', '0.4')} ELSE 0 END)) < {_P} - 1e-12))"), "f_critbinom": ("=CRITBINOM(20, 0.4, p_size / 60)", f"len(list_filter(range(0, 21), lambda m: list_sum(list_transform(range(0, 21), lambda k: CASE WHEN k <= m THEN {_binom('k', '20', '0.4')} ELSE 0 END)) < {_P} - 1e-12))"),
    "f_hypgeom": ("=HYPGEOMDIST(MOD(p_size, 4), 5, 8, 20, TRUE)", _SUM.format(n=5, t=f"CASE WHEN k <= p_size % 4 THEN {_comb('8', 'k')} * {_comb('12', '5 - k')} / {_comb('20', '5')} ELSE 0 END")), "f_negbinom": ("=NEGBINOMDIST(MOD(p_size, 9), 3, 0.4, TRUE)", _SUM.format(n=9, t=f"CASE WHEN k <= p_size % 9 THEN {_comb('k + 2', '2')} * pow(0.4, 3) * pow(0.6, k) ELSE 0 END")),
    "f_poisson": ("=POISSON(MOD(p_size, 9), 3.5, TRUE)", _SUM.format(n=9, t="CASE WHEN k <= p_size % 9 THEN exp(-3.5 + k * ln(3.5) - lgamma(k + 1)) ELSE 0 END")), "f_expon": ("=EXPON.DIST(p_size, 0.1, TRUE)", f"1 - exp(-0.1 * {_S})"), "f_weibull": ("=WEIBULL(p_size, 2, 20, FALSE)", f"2 / pow(20, 2) * {_S} * exp(-pow(p_size / 20.0::DOUBLE, 2))"),
})
rows_query("distributions_gamma", "part", ["p_partkey"], {
    "f_gammadist": ("=GAMMADIST(p_size, 2.5, 6, TRUE)", _gamma("2.5", f"({_S} / 6)")), "f_gamma_pdf": ("=GAMMA.DIST(p_size, 2.5, 6, FALSE)", f"exp(1.5 * ln({_S}) - p_size / 6.0::DOUBLE - lgamma(2.5) - 2.5 * ln(6))"), "f_gammainv": ("=GAMMADIST(GAMMAINV(p_size / 60, 2.5, 6), 2.5, 6, TRUE)", _P), "f_gammaln": ("=GAMMALN.PRECISE(p_size / 60)", f"lgamma({_P})"),
    "f_chisq": ("=CHISQ.DIST(p_size, 7, TRUE)", _gamma("3.5", f"({_S} / 2)")), "f_chisq_pdf": ("=CHISQ.DIST(p_size, 7, FALSE)", f"exp(2.5 * ln({_S}) - p_size / 2.0::DOUBLE - 3.5 * ln(2) - lgamma(3.5))"), "f_chidist": ("=CHIDIST(p_size, 7)", f"1 - {_gamma('3.5', f'({_S} / 2)')}"), "f_chisq_inv": ("=CHISQ.DIST(CHISQ.INV(p_size / 60, 7), 7, TRUE)", _P), "f_chiinv": ("=CHIDIST(CHIINV(p_size / 60, 7), 7)", _P),
})
_F = f"(3.0 * {_P} / (3.0 * {_P} + 9.0))"
rows_query("distributions_beta", "part", ["p_partkey"], {
    "f_betadist": ("=BETADIST(p_size / 60, 2.5, 4, TRUE)", _beta("2.5", "4.0", _P)), "f_beta_scaled": ("=BETA.DIST(p_size, 2.5, 4, TRUE, 0, 60)", _beta("2.5", "4.0", _P)), "f_betainv": ("=BETADIST(BETAINV(p_size / 60, 2.5, 4), 2.5, 4, TRUE)", _P), "f_t": ("=T.DIST((p_size - 25) / 10, 6, TRUE)", _t(_Z, "6.0")), "f_t_pdf": ("=T.DIST(p_size / 60, 6, FALSE)", f"exp(lgamma(3.5) - lgamma(3)) / sqrt(6 * pi()) * pow(1 + {_P} * {_P} / 6, -3.5)"),
    "f_t_rt": ("=T.DIST.RT((p_size - 25) / 10, 6)", f"1 - {_t(_Z, '6.0')}"), "f_tdist": ("=TDIST((p_size - 25) / 10, 6)", f"1 - {_t(_Z, '6.0')}"), "f_t_2t": ("=T.DIST.2T(p_size / 60, 6)", f"2 * (1 - {_t(_P, '6.0')})"), "f_t_inv": ("=T.INV(p_size / 60, 2)", f"(2 * {_P} - 1) / sqrt(2 * {_P} * (1 - {_P}))"), "f_t_inv_2t": ("=T.INV.2T(p_size / 60, 2)", f"(1 - {_P}) / sqrt(2 * (1 - {_P} / 2) * {_P} / 2)"),
    "f_tinv": ("=TINV(p_size / 60, 2)", f"(1 - {_P}) / sqrt(2 * (1 - {_P} / 2) * {_P} / 2)"), "f_f": ("=F.DIST(p_size / 60, 3, 9, TRUE)", _beta("1.5", "4.5", _F)), "f_f_rt": ("=F.DIST.RT(p_size / 60, 3, 9)", f"1 - {_beta('1.5', '4.5', _F)}"), "f_f_inv": ("=F.INV(p_size / 60, 2, 4)", f"2 * (pow(1 - {_P}, -0.5) - 1)"), "f_f_inv_rt": ("=F.INV.RT(p_size / 60, 2, 4)", f"2 * (pow({_P}, -0.5) - 1)"),
})

# Tests on different columns, by order: few rows each

_STATS = "SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS a, avg(l_linenumber) AS b, var_samp(l_quantity) AS va, var_samp(l_linenumber) AS vb, avg(l_quantity - l_linenumber) AS ad, stddev_samp(l_quantity - l_linenumber) AS sd, sum(pow(l_quantity - l_linenumber, 2) / l_linenumber) AS x2 FROM lineitem GROUP BY 1 HAVING count(*) > 2 AND var_samp(l_quantity) > 0 AND var_samp(l_linenumber) > 0 AND stddev_samp(l_quantity - l_linenumber) > 0"
_H = "(n - 1) / 2.0::DOUBLE"


def _two_sided(t: str, v: str) -> str:
    return f"2 * (0.5 * {_beta(f'({v} / 2)', '0.5', f'({v} / ({v} + pow({t}, 2)))')})"


_PF = _beta(f"({_H})", f"({_H})", "(va / (va + vb))")
_WELCH = "(pow(va / n + vb / n, 2) / (pow(va / n, 2) / (n - 1) + pow(vb / n, 2) / (n - 1)))"


@query(
    f"SELECT l_orderkey, round(2 * least({_PF}, 1 - {_PF}), 5) + 0.0 AS ftest, round({_two_sided('((a - b) / sqrt((va + vb) / 2 * 2 / n))', '(2.0::DOUBLE * n - 2)')}, 5) + 0.0 AS ttest_pooled, round({_two_sided('((a - b) / sqrt(va / n + vb / n))', _WELCH)} / 2, 5) + 0.0 AS ttest_welch, "
    f"round({_two_sided('(ad / (sd / sqrt(n)))', '(n - 1.0::DOUBLE)')}, 5) + 0.0 AS ttest_paired, round(1 - {_phi('((a - 25) / (sqrt(va) / sqrt(n)))')}, 5) + 0.0 AS ztest, round(1 - {_phi('((a - 25) / (14 / sqrt(n)))')}, 5) + 0.0 AS ztest_known, round(greatest(1 - {_gamma(f'({_H})', 'least(x2 / 2, 100.0)')}, 0), 5) + 0.0 AS chitest FROM ({_STATS})"
)
def agg_tests_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    tests = {
        "ftest": "=FTEST(l_quantity, l_linenumber)", "ttest_pooled": "=TTEST(l_quantity, l_linenumber, 2, 2)", "ttest_welch": "=T.TEST(l_quantity, l_linenumber, 1, 3)", "ttest_paired": "=T.TEST(l_quantity, l_linenumber, 2, 1)",
        "ztest": "=ZTEST(l_quantity, 25)", "ztest_known": "=Z.TEST(l_quantity, 25, 14)", "chitest": "=CHITEST(l_quantity, l_linenumber)", "n": "=COUNT(l_quantity)", "v": "=IFERROR(VAR.S(l_quantity), 0)", "sd": "=IFERROR(STDEV.S(d), 0)", "v2": "=IFERROR(VAR.S(l_linenumber), 0)",
    }
    out = formula.summarize(li.withColumn("d", F.col("l_quantity") - F.col("l_linenumber")), tests, ["l_orderkey"]).where("n > 2 and v > 0 and sd > 0 and v2 > 0").drop("n", "v", "sd", "v2")
    return rounded(out, out.columns, 5)


@query("SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) + 0.0 AS avedev, round(stddev_pop(l_quantity), 6) + 0.0 AS stdev_p, round(var_samp(l_tax), 6) + 0.0 AS var_s, round(var_pop(l_tax), 6) + 0.0 AS varp, round(covar_pop(l_quantity, l_tax), 6) + 0.0 AS covariance_p FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON l_returnflag = f GROUP BY 1")
def agg_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {"avedev": "=AVEDEV(l_quantity)", "stdev_p": "=STDEV.P(l_quantity)", "var_s": "=VAR.S(l_tax)", "varp": "=VARP(l_tax)", "covariance_p": "=COVARIANCE.P(l_quantity, l_tax)"}
    return rounded(formula.summarize(read(spark, sf_dir, "lineitem"), f, ["l_returnflag"]), list(f))


_C = "(p_size / 10.0::DOUBLE)"
rows_query("complex_functions", "part", ["p_partkey"], {
    "f_sinh": ("=IMREAL(IMSINH(COMPLEX(p_size / 10, 1)))", f"sinh({_C}) * cos(1)"), "f_cosh": ("=IMAGINARY(IMCOSH(COMPLEX(p_size / 10, 1)))", f"sinh({_C}) * sin(1)"), "f_tanh": ("=IMREAL(IMTANH(COMPLEX(p_size / 10, 1)))", f"sinh(2 * {_C}) / (cosh(2 * {_C}) + cos(2))"), "f_sec": ("=IMREAL(IMSEC(COMPLEX(1, p_size / 10)))", f"cos(1) * cosh({_C}) / (pow(cos(1) * cosh({_C}), 2) + pow(sin(1) * sinh({_C}), 2))"),
    "f_sech": ("=IMREAL(IMSECH(COMPLEX(p_size / 10, 1)))", f"cosh({_C}) * cos(1) / (pow(cosh({_C}) * cos(1), 2) + pow(sinh({_C}) * sin(1), 2))"), "f_csc": ("=IMREAL(IMCSC(COMPLEX(1, p_size / 10)))", f"sin(1) * cosh({_C}) / (pow(sin(1) * cosh({_C}), 2) + pow(cos(1) * sinh({_C}), 2))"), "f_csch": ("=IMREAL(IMCSCH(COMPLEX(p_size / 10, 1)))", f"sinh({_C}) * cos(1) / (pow(sinh({_C}) * cos(1), 2) + pow(cosh({_C}) * sin(1), 2))"),
    "f_cot": ("=IMREAL(IMCOT(COMPLEX(1, p_size / 10)))", f"sin(2) / (cosh(2 * {_C}) - cos(2))"), "f_log2": ("=IMREAL(IMLOG2(COMPLEX(3 * p_size, 4 * p_size)))", "log2(5 * p_size)"), "f_radians": ("=RADIANS(p_size)", "p_size * pi() / 180"), "f_degrees": ("=DEGREES(p_size)", "p_size * 180 / pi()"),
})
rows_query("text_and_bonds", "part", ["p_partkey"], {
    "f_proper": ('=PROPER(CONCAT("a ", p_brand))', "'A ' || upper(p_brand[1]) || lower(p_brand[2:])", "text"), "f_dbcs": ("=LEN(DBCS(p_brand))", "length(p_brand)"), "f_searchb": ('=IFERROR(SEARCHB("A", p_name), 0)', "position('a' IN lower(p_name))"), "f_roman": ("=ARABIC(ROMAN(p_size + 400))", "p_size + 400"), "f_true": ("=IF(TRUE(), p_size, 0)", "p_size"), "f_false": ("=IF(FALSE(), 0, p_size)", "p_size"),
    "f_isformula": ("=ISFORMULA(p_name)", "false", "bool"), "f_formulatext": ('=IFERROR(FORMULATEXT(p_name), "none")', "'none'", "text"), "f_formulatext2": ('=FORMULATEXT(CONCAT("=", p_size))', "'=' || p_size", "text"), "f_accrint": ('=ACCRINT("2024-01-01", "2024-06-01", "2024-12-26", 0.1, p_size)', "p_size * 0.1"), "f_na": ("=IFNA(IF(p_size > 25, NA(), p_size), 0)", "CASE WHEN p_size > 25 THEN 0 ELSE p_size END"),
    "f_disc": ('=DISC("2024-01-01", "2024-12-26", p_size, 100)', "(100 - p_size) / 100.0::DOUBLE"), "f_intrate": ('=INTRATE("2024-01-01", "2024-12-26", p_size, 100)', "(100 - p_size) / p_size::DOUBLE"), "f_yielddisc": ('=YIELDDISC("2024-01-01", "2024-12-26", p_size, 100)', "(100 - p_size) / p_size::DOUBLE"), "f_accrintm": ('=ACCRINTM("2024-01-01", "2024-12-26", 0.1, p_size)', "p_size * 0.1"),
    "f_dollarde": ("=DOLLARDE(p_size + 0.02, 16)", "p_size + 0.125"), "f_dollarfr": ("=DOLLARFR(p_size + 0.125, 16)", "p_size + 0.02"), "f_db": ("=DB(1000 * p_size, 100 * p_size, 6, 1)", "319 * p_size"), "f_rate": ("=RATE(1, 0, -100, 100 + p_size)", "p_size / 100.0::DOUBLE"), "f_duration": ('=DURATION("2020-01-01", "2021-12-21", p_size / 100, 0.08, 1)', "(p_size / 1.08 + 2 * (100 + p_size) / pow(1.08, 2)) / (p_size / 1.08 + (100 + p_size) / pow(1.08, 2))"),
    "f_time": ("=TIME(MOD(p_size, 24), 30, 0)", "(p_size % 24 * 3600 + 1800) / 86400.0::DOUBLE"), "f_arraytotext": ("=TYPE(p_size) + N(TRUE)", "2"), "f_arity": ('=IFERROR(TDIST(p_size, 60, 2), "arity")', "'arity'", "text"), "f_arity2": ('=IFERROR(ROUND(p_size), "arity")', "'arity'", "text"),
})


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_acctbal DESC, c_custkey) AS place FROM customer")
def sort_custom_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's place in the order of a custom list, those not in it last."""
    from tabulon.operators import tables as op

    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    listed = ["MACHINERY", "BUILDING"]
    keys = [op.sort_key(c, "c_mktsegment", custom=listed), op.sort_key(c, "c_acctbal", descending=True), op.sort_key(c, "c_custkey")]
    segment = F.when(F.col("c_mktsegment") == listed[0], 1).when(F.col("c_mktsegment") == listed[1], 2).otherwise(3)
    # a range for each segment and, falling, each thousand of the balance
    return op.numbered(c, keys, F.struct(segment, -F.floor(F.col("c_acctbal") / 1000)), "place").select("c_custkey", "place")
