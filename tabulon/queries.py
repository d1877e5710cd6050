"""Registered queries over the test tables, and their SQL.

A formula query is a table, its key columns and, for each result column, a formula with the SQL that says the
same.  Numeric results are rounded on both sides, for sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.plans import formula

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: list[str], digits: int = DIGITS) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns if isinstance(kinds[c], (T.DoubleType, T.FloatType))})


def _sql_column(alias: str, spec: tuple[str, ...]) -> str:
    expr, kind = spec[1], spec[2] if len(spec) > 2 else "num"
    return f"round(CAST({expr} AS DOUBLE), {DIGITS}) + 0.0 AS {alias}" if kind == "num" else f"{expr} AS {alias}"


def rows_query(name: str, table: str, keys: list[str], columns: dict[str, tuple[str, ...]], where: str = "true") -> None:
    """Formulas of each row; a column's spec is (formula, SQL) for numbers or (formula, SQL, kind)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = formula.calculate(read(spark, sf_dir, table).where(where), {k: v[0] for k, v in columns.items()})
        return rounded(df.select(*keys, *columns), list(columns))

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(keys)}, {', '.join(_sql_column(k, v) for k, v in columns.items())} FROM {table} WHERE {where}"


def groups_query(name: str, table: str, by: list[str], columns: dict[str, tuple[str, ...]], large_groups: bool = False) -> None:
    """Aggregate formulas of each group."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(formula.summarize(read(spark, sf_dir, table), {k: v[0] for k, v in columns.items()}, by, large_groups=large_groups), list(columns))

    QUERIES[name] = run
    group = f" GROUP BY {', '.join(by)}" if by else ""
    SQL[name] = f"SELECT {', '.join([*by, *[_sql_column(k, v) for k, v in columns.items()]])} FROM {table}{group}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by return flag over lines that meet criteria strings."""
    li = read(spark, sf_dir, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(formula.summarize(li, {"total": '=SUMIFS(revenue, l_quantity, ">=10", l_linestatus, "<>X")', "n": '=COUNTIFS(l_quantity, ">=10")'}, ["l_returnflag"]), ["total"], 2)


QUERIES["flagship"] = flagship
SQL["flagship"] = "SELECT l_returnflag, round(sum(CASE WHEN l_quantity >= 10 AND l_linestatus <> 'X' THEN l_extendedprice * (1 - l_discount) END), 2) + 0.0 AS total, CAST(count(*) FILTER (WHERE l_quantity >= 10) AS DOUBLE) AS n FROM lineitem GROUP BY 1"

LINE = ["l_orderkey", "l_linenumber"]
_x, _q, _d = "l_extendedprice", "l_quantity", "l_discount"
_HALF = "sign({x}) * floor(abs({x}) * pow(10, {d}) + 0.5) / pow(10, {d})"

# Aggregates

groups_query("agg_basic", "lineitem", ["l_returnflag", "l_linestatus"], {
    "f_sum": ("=SUM(l_quantity)", "sum(l_quantity)"), "f_sum2": ("=SUM(l_quantity, l_tax)", "sum(l_quantity) + sum(l_tax)"), "f_average": ("=AVERAGE(l_extendedprice)", "avg(l_extendedprice)"), "f_count": ("=COUNT(l_discount)", "count(l_discount)"), "f_counttext": ("=COUNT(l_returnflag)", "0"),
    "f_counta": ("=COUNTA(l_returnflag)", "count(l_returnflag)"), "f_countblank": ("=COUNTBLANK(l_returnflag)", "count(*) FILTER (WHERE coalesce(l_returnflag, '') = '')"), "f_min": ("=MIN(l_extendedprice)", "min(l_extendedprice)"), "f_max": ("=MAX(l_extendedprice, l_tax)", "greatest(max(l_extendedprice), max(l_tax))"),
    "f_mina": ("=MINA(l_linestatus)", "0"), "f_maxa": ("=MAXA(l_quantity)", "max(l_quantity)"), "f_averagea": ("=AVERAGEA(l_linestatus)", "0"), "f_sumsq": ("=SUMSQ(l_tax)", "sum(l_tax * l_tax)"), "f_sumproduct": ("=SUMPRODUCT(l_quantity, l_discount)", "sum(l_quantity * l_discount)"), "f_sumtext": ("=SUM(l_returnflag)", "0"),
})
groups_query("agg_product_logic", "lineitem", ["l_orderkey"], {
    "f_product": ("=PRODUCT(l_quantity)", "product(l_quantity)"), "f_and": ("=AND(l_discount)", "bool_and(l_discount <> 0)", "bool"), "f_or": ("=OR(l_tax)", "bool_or(l_tax <> 0)", "bool"), "f_xor": ("=XOR(l_tax)", "(count(*) FILTER (WHERE l_tax <> 0)) % 2 = 1", "bool"),
    "f_rows": ("=ROWS(l_tax)", "count(*)"), "f_large": ("=LARGE(l_quantity, 2)", "list_reverse_sort(list(l_quantity))[2]"), "f_small": ("=SMALL(l_quantity, 1)", "min(l_quantity)"), "f_fvschedule": ("=FVSCHEDULE(100, l_tax)", "100 * product(1 + l_tax)"),
    "f_trimmean": ("=TRIMMEAN(l_quantity, 0.4)", "list_avg(list_sort(list(l_quantity))[floor(floor(count(*) * 0.4) / 2)::INT + 1:count(*)::INT - floor(floor(count(*) * 0.4) / 2)::INT])"),
})
groups_query("agg_criteria", "lineitem", ["l_returnflag"], {
    "f_sumif": ('=SUMIF(l_quantity, ">25")', "coalesce(sum(CASE WHEN l_quantity > 25 THEN l_quantity END), 0)"), "f_sumif3": ('=SUMIF(l_linestatus, "O", l_tax)', "coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_tax END), 0)"), "f_sumifs": ('=SUMIFS(l_extendedprice, l_quantity, ">=10", l_discount, "<>0.05", l_linestatus, "F*")', "coalesce(sum(CASE WHEN l_quantity >= 10 AND l_discount <> 0.05 AND l_linestatus LIKE 'F%' THEN l_extendedprice END), 0)"),
    "f_countif": ('=COUNTIF(l_linestatus, "?")', "count(*) FILTER (WHERE length(l_linestatus) = 1)"), "f_countifs": ('=COUNTIFS(l_quantity, "<=5", l_tax, 0.02)', "count(*) FILTER (WHERE l_quantity <= 5 AND l_tax = 0.02)"), "f_countne": ('=COUNTIF(l_linestatus, "<>5")', "0"), "f_averageif": ('=AVERAGEIF(l_quantity, "=7", l_extendedprice)', "avg(CASE WHEN l_quantity = 7 THEN l_extendedprice END)"),
    "f_averageifs": ('=AVERAGEIFS(l_extendedprice, l_tax, "<0.03", l_quantity, ">49")', "avg(CASE WHEN l_tax < 0.03 AND l_quantity > 49 THEN l_extendedprice END)"), "f_minifs": ('=MINIFS(l_extendedprice, l_quantity, ">30")', "coalesce(min(CASE WHEN l_quantity > 30 THEN l_extendedprice END), 0)"), "f_maxifs": ('=MAXIFS(l_extendedprice, l_quantity, ">900")', "0"),
})
groups_query("agg_statistics", "lineitem", ["l_returnflag"], {
    "f_stdev": ("=STDEV(l_quantity)", "stddev_samp(l_quantity)"), "f_stdev_s": ("=STDEV.S(l_tax)", "stddev_samp(l_tax)"), "f_stdevp": ("=STDEVP(l_quantity)", "stddev_pop(l_quantity)"), "f_var": ("=VAR(l_quantity)", "var_samp(l_quantity)"), "f_varp": ("=VAR.P(l_quantity)", "var_pop(l_quantity)"), "f_stdeva": ("=STDEVA(l_quantity)", "stddev_samp(l_quantity)"),
    "f_stdevpa": ("=STDEVPA(l_linestatus)", "0"), "f_vara": ("=VARA(l_tax)", "var_samp(l_tax)"), "f_varpa": ("=VARPA(l_tax)", "var_pop(l_tax)"), "f_devsq": ("=DEVSQ(l_quantity)", "var_pop(l_quantity) * count(l_quantity)"), "f_median": ("=MEDIAN(l_extendedprice)", "median(l_extendedprice)"), "f_geomean": ("=GEOMEAN(l_quantity)", "exp(avg(ln(l_quantity)))"),
    "f_harmean": ("=HARMEAN(l_quantity)", "count(*) / sum(1 / l_quantity)"), "f_skew": ("=SKEW(l_quantity)", "skewness(l_quantity)"), "f_skew_p": ("=SKEW.P(l_quantity)", "skewness(l_quantity) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))"), "f_kurt": ("=KURT(l_quantity)", "kurtosis(l_quantity)"), "f_correl": ("=CORREL(l_quantity, l_extendedprice)", "corr(l_quantity, l_extendedprice)"),
    "f_pearson": ("=PEARSON(l_quantity, l_tax)", "corr(l_quantity, l_tax)"), "f_rsq": ("=RSQ(l_extendedprice, l_quantity)", "pow(corr(l_quantity, l_extendedprice), 2)"), "f_covar": ("=COVAR(l_quantity, l_tax)", "covar_pop(l_quantity, l_tax)"), "f_covar_s": ("=COVARIANCE.S(l_quantity, l_tax)", "covar_samp(l_quantity, l_tax)"), "f_slope": ("=SLOPE(l_extendedprice, l_quantity)", "regr_slope(l_extendedprice, l_quantity)"),
    "f_intercept": ("=INTERCEPT(l_quantity, l_tax)", "regr_intercept(l_quantity, l_tax)"), "f_steyx": ("=STEYX(l_quantity, l_tax)", "sqrt((regr_syy(l_quantity, l_tax) - pow(regr_sxy(l_quantity, l_tax), 2) / regr_sxx(l_quantity, l_tax)) / (count(*) - 2))"), "f_sumx2my2": ("=SUMX2MY2(l_quantity, l_tax)", "sum(l_quantity * l_quantity - l_tax * l_tax)"),
    "f_sumx2py2": ("=SUMX2PY2(l_quantity, l_tax)", "sum(l_quantity * l_quantity + l_tax * l_tax)"), "f_sumxmy2": ("=SUMXMY2(l_quantity, l_tax)", "sum(pow(l_quantity - l_tax, 2))"), "f_prob": ("=PROB(l_quantity, l_tax, 10, 20)", "sum(CASE WHEN l_quantity BETWEEN 10 AND 20 THEN l_tax END)"),
}, large_groups=True)
groups_query("agg_percentiles", "orders", ["o_orderpriority"], {
    "f_percentile": ("=PERCENTILE(o_totalprice, 0.3)", "quantile_cont(o_totalprice, 0.3)"), "f_percentile_inc": ("=PERCENTILE.INC(o_totalprice, 0.95)", "quantile_cont(o_totalprice, 0.95)"), "f_quartile": ("=QUARTILE(o_totalprice, 1)", "quantile_cont(o_totalprice, 0.25)"), "f_quartile_inc": ("=QUARTILE.INC(o_totalprice, 3)", "quantile_cont(o_totalprice, 0.75)"),
    "f_percentile_exc": ("=PERCENTILE.EXC(o_totalprice, 0.4)", "list_sort(list(o_totalprice))[floor(0.4 * (count(*) + 1))::INT] + (0.4 * (count(*) + 1) - floor(0.4 * (count(*) + 1))) * (list_sort(list(o_totalprice))[floor(0.4 * (count(*) + 1))::INT + 1] - list_sort(list(o_totalprice))[floor(0.4 * (count(*) + 1))::INT])"),
    "f_quartile_exc": ("=QUARTILE.EXC(o_totalprice, 3)", "list_sort(list(o_totalprice))[floor(0.75 * (count(*) + 1))::INT] + (0.75 * (count(*) + 1) - floor(0.75 * (count(*) + 1))) * (list_sort(list(o_totalprice))[floor(0.75 * (count(*) + 1))::INT + 1] - list_sort(list(o_totalprice))[floor(0.75 * (count(*) + 1))::INT])"),
    "f_mode": ("=MODE.SNGL(o_custkey)", "(list_sort(list_transform(map_entries(histogram(o_custkey)), lambda e: {'n': -e.value::BIGINT, 'v': e.key}))[1]).v"),
}, large_groups=True)
groups_query("agg_errors", "lineitem", ["l_linestatus"], {
    "f_iferror": ('=IFERROR(AVERAGEIF(l_quantity, ">999"), -1)', "-1"), "f_iserror": ('=ISERROR(AVERAGEIFS(l_tax, l_quantity, ">999"))', "true", "bool"), "f_ratio": ("=ROUND(SUM(l_tax) / COUNT(l_tax), 4)", _HALF.format(x="(sum(l_tax) / count(l_tax))", d=4)), "f_if": ('=IF(COUNT(l_tax) > 10, "many", "few")', "CASE WHEN count(l_tax) > 10 THEN 'many' ELSE 'few' END", "text"), "f_geomean": ("=IFERROR(GEOMEAN(l_discount), 0)", "0"),
})

# Mathematics

rows_query("math_rounding", "lineitem", LINE, {
    "f_round": ("=ROUND(l_extendedprice, 1)", _HALF.format(x=_x, d=1)), "f_roundneg": ("=ROUND(l_extendedprice, -2)", _HALF.format(x=_x, d=-2)), "f_rounddown": ("=ROUNDDOWN(-l_extendedprice, 1)", f"-floor({_x} * 10) / 10"), "f_roundup": ("=ROUNDUP(-l_extendedprice, 1)", f"-ceil({_x} * 10) / 10"), "f_int": ("=INT(-l_extendedprice)", f"floor(-{_x})"), "f_trunc": ("=TRUNC(-l_extendedprice)", f"-floor({_x})"),
    "f_floor": ("=FLOOR(l_extendedprice, 7)", f"floor({_x} / 7) * 7"), "f_ceiling": ("=CEILING(l_extendedprice, 7)", f"ceil({_x} / 7) * 7"), "f_floor_math": ("=FLOOR.MATH(-l_extendedprice, 7, 1)", f"ceil(-{_x} / 7) * 7"), "f_ceiling_math": ("=CEILING.MATH(-l_extendedprice, 7, 1)", f"floor(-{_x} / 7) * 7"), "f_floor_precise": ("=FLOOR.PRECISE(l_extendedprice, -7)", f"floor({_x} / 7) * 7"),
    "f_ceiling_precise": ("=CEILING.PRECISE(l_extendedprice, -7)", f"ceil({_x} / 7) * 7"), "f_iso_ceiling": ("=ISO.CEILING(l_quantity, 4)", "ceil(l_quantity / 4) * 4"), "f_mround": ("=MROUND(l_quantity, 4)", "floor(l_quantity / 4 + 0.5) * 4"), "f_mod": ("=MOD(-l_quantity, 7)", "-l_quantity - 7 * floor(-l_quantity / 7)"), "f_quotient": ("=QUOTIENT(-l_quantity, 7)", "-floor(l_quantity / 7)"),
    "f_even": ("=EVEN(l_quantity)", "ceil(l_quantity / 2) * 2"), "f_odd": ("=ODD(l_quantity)", "ceil((l_quantity + 1) / 2) * 2 - 1"), "f_sign": ("=SIGN(l_discount - 0.05)", "sign(l_discount - 0.05)"), "f_abs": ("=ABS(l_discount - 0.05)", "abs(l_discount - 0.05)"),
})
rows_query("math_powers", "lineitem", LINE, {
    "f_power": ("=POWER(l_quantity, 1.5)", "pow(l_quantity, 1.5)"), "f_sqrt": ("=SQRT(l_quantity)", "sqrt(l_quantity)"), "f_sqrtpi": ("=SQRTPI(l_quantity)", "sqrt(l_quantity * pi())"), "f_exp": ("=EXP(l_tax)", "exp(l_tax)"), "f_ln": ("=LN(l_quantity)", "ln(l_quantity)"), "f_log10": ("=LOG10(l_quantity)", "log10(l_quantity)"), "f_log": ("=LOG(l_quantity)", "log10(l_quantity)"),
    "f_log3": ("=LOG(l_quantity, 3)", "ln(l_quantity) / ln(3)"), "f_pi": ("=PI() * l_quantity", "pi() * l_quantity"), "f_delta": ("=DELTA(l_quantity, 7)", "CASE WHEN l_quantity = 7 THEN 1 ELSE 0 END"), "f_gestep": ("=GESTEP(l_quantity, 25)", "CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END"), "f_phi": ("=PHI(l_tax)", "exp(-l_tax * l_tax / 2) / sqrt(2 * pi())"), "f_fisher": ("=FISHER(l_tax)", "atanh(l_tax)"), "f_fisherinv": ("=FISHERINV(l_quantity / 10)", "tanh(l_quantity / 10)"),
    "f_standardize": ("=STANDARDIZE(l_quantity, 25, 4)", "(l_quantity - 25) / 4"), "f_expon": ("=EXPON.DIST(l_tax, 2, 1)", "1 - exp(-2 * l_tax)"), "f_exponpdf": ("=EXPONDIST(l_tax, 2, 0)", "2 * exp(-2 * l_tax)"), "f_weibull": ("=WEIBULL.DIST(l_quantity, 2, 30, 1)", "1 - exp(-pow(l_quantity / 30, 2))"), "f_permutationa": ("=PERMUTATIONA(l_linenumber, 3)", "pow(l_linenumber, 3)"),
})
rows_query("math_trig", "lineitem", LINE, {
    f"f_{n.lower()}": (f"={n}(l_quantity / 60)", s.format(x="(l_quantity / 60)")) for n, s in {
        "SIN": "sin({x})", "COS": "cos({x})", "TAN": "tan({x})", "COT": "1 / tan({x})", "CSC": "1 / sin({x})", "SEC": "1 / cos({x})", "ASIN": "asin({x})", "ACOS": "acos({x})", "ATAN": "atan({x})", "ACOT": "pi() / 2 - atan({x})", "SINH": "sinh({x})", "COSH": "cosh({x})", "TANH": "tanh({x})", "CSCH": "1 / sinh({x})", "SECH": "1 / cosh({x})", "COTH": "cosh({x}) / sinh({x})", "ASINH": "asinh({x})", "ATANH": "atanh({x})", "RADIANS": "radians({x})", "DEGREES": "degrees({x})",
    }.items()
} | {"f_atan2": ("=ATAN2(l_quantity, l_linenumber)", "atan2(l_quantity, l_linenumber)"), "f_acosh": ("=ACOSH(l_quantity)", "acosh(l_quantity)"), "f_acoth": ("=ACOTH(l_quantity + 1)", "0.5 * ln((l_quantity + 2) / l_quantity)")})
rows_query("math_combinatorics", "part", ["p_partkey"], {
    "f_fact": ("=FACT(MOD(p_size, 15))", "factorial(p_size % 15)"), "f_combin": ("=COMBIN(p_size + 3, 3)", "(p_size + 3) * (p_size + 2) * (p_size + 1) / 6"), "f_combina": ("=COMBINA(p_size, 2)", "(p_size + 1) * p_size / 2"), "f_permut": ("=PERMUT(p_size + 2, 2)", "(p_size + 2) * (p_size + 1)"), "f_multinomial": ("=MULTINOMIAL(p_size, 1)", "p_size + 1"), "f_factdouble": ("=FACTDOUBLE(4) * p_size", "8 * p_size"),
    "f_gcd": ("=GCD(p_size, 12)", "gcd(p_size, 12)"), "f_lcm": ("=LCM(p_size, 12)", "lcm(p_size, 12)"), "f_bitand": ("=BITAND(p_size, 12)", "p_size & 12"), "f_bitor": ("=BITOR(p_size, 12)", "p_size | 12"), "f_bitxor": ("=BITXOR(p_size, 12)", "xor(p_size, 12)"), "f_bitlshift": ("=BITLSHIFT(p_size, 3)", "p_size * 8"), "f_bitrshift": ("=BITRSHIFT(p_size, 2)", "p_size // 4"),
})
rows_query("math_bases", "part", ["p_partkey"], {
    "f_dec2bin": ("=DEC2BIN(p_size)", "bin(p_size)", "text"), "f_dec2hex": ("=DEC2HEX(p_size, 4)", "lpad(hex(p_size), 4, '0')", "text"), "f_dec2oct": ("=DEC2OCT(p_size)", "CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END || (p_size % 8)::VARCHAR", "text"), "f_dec2hexneg": ("=DEC2HEX(-p_size)", "hex(1099511627776 - p_size)", "text"), "f_bin2dec": ("=BIN2DEC(DEC2BIN(p_size))", "p_size"), "f_bin2neg": ("=BIN2DEC(DEC2BIN(-p_size))", "-p_size"),
})
rows_query("math_bases_hex", "part", ["p_partkey"], {
    "f_hex2dec": ("=HEX2DEC(DEC2HEX(-p_size))", "-p_size"), "f_oct2dec": ("=OCT2DEC(DEC2OCT(-p_size))", "-p_size"), "f_hex2bin": ("=HEX2BIN(DEC2HEX(p_size))", "bin(p_size)", "text"), "f_oct2hex": ("=OCT2HEX(DEC2OCT(p_size))", "hex(p_size)", "text"), "f_bin2hex": ("=BIN2HEX(DEC2BIN(p_size), 3)", "lpad(hex(p_size), 3, '0')", "text"), "f_bin2oct": ("=BIN2OCT(DEC2BIN(p_size))", "CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END || (p_size % 8)::VARCHAR", "text"),
})
rows_query("math_bases_oct", "part", ["p_partkey"], {
    "f_hex2oct": ("=HEX2OCT(DEC2HEX(p_size))", "CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END || (p_size % 8)::VARCHAR", "text"), "f_oct2bin": ("=OCT2BIN(DEC2OCT(p_size))", "bin(p_size)", "text"), "f_base": ("=BASE(p_size, 2, 8)", "lpad(bin(p_size), 8, '0')", "text"), "f_decimal": ("=DECIMAL(BASE(p_size, 16), 16)", "p_size"),
})

# Logic, information, text

rows_query("logic_info", "part", ["p_partkey"], {
    "f_if": ('=IF(p_size > 25, "large", "small")', "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END", "text"), "f_ifs": ('=IFS(p_size < 10, "a", p_size < 30, "b", TRUE, "c")', "CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'b' ELSE 'c' END", "text"), "f_switch": ('=SWITCH(p_size, 1, "one", 2, "two", "many")', "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END", "text"), "f_not": ("=NOT(p_size - 1)", "p_size = 1", "bool"),
    "f_iferror": ("=IFERROR(1 / (p_size - 1), -1)", "CASE WHEN p_size = 1 THEN -1 ELSE 1.0::DOUBLE / (p_size - 1) END"), "f_ifna": ('=IFNA(SWITCH(p_size, 1, 5), 7)', "CASE WHEN p_size = 1 THEN 5 ELSE 7 END"), "f_choose": ('=CHOOSE(MOD(p_size, 3) + 1, "x", "y", "z")', "CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END", "text"), "f_isblank": ("=ISBLANK(p_name)", "coalesce(p_name, '') = ''", "bool"), "f_iserror": ("=ISERROR(1 / (p_size - 1))", "p_size = 1", "bool"),
    "f_iserr": ("=ISERR(NA())", "false", "bool"), "f_isna": ("=ISNA(NA())", "true", "bool"), "f_isnumber": ("=ISNUMBER(p_size)", "true", "bool"), "f_istext": ("=ISTEXT(p_name)", "true", "bool"), "f_islogical": ("=ISLOGICAL(p_size > 1)", "true", "bool"), "f_isnontext": ("=ISNONTEXT(p_size)", "true", "bool"), "f_iseven": ("=ISEVEN(p_size)", "p_size % 2 = 0", "bool"), "f_isodd": ("=ISODD(p_size)", "p_size % 2 = 1", "bool"),
    "f_n": ("=N(p_size > 5)", "CASE WHEN p_size > 5 THEN 1 ELSE 0 END"), "f_t": ("=T(p_size)", "''", "text"), "f_type": ("=TYPE(p_name)", "2"), "f_value": ('=VALUE(CONCAT(p_size, ".5"))', "p_size + 0.5"), "f_compare": ("=p_brand > p_type", "p_brand > p_type", "bool"), "f_info": ('=INFO("system")', "'pcdos'", "text"), "f_isref": ("=ISREF(p_size)", "true", "bool"),
})
rows_query("text_basic", "part", ["p_partkey"], {
    "f_len": ("=LEN(p_name)", "length(p_name)"), "f_lenb": ("=LENB(p_name)", "strlen(p_name)"), "f_lower": ("=LOWER(p_brand)", "lower(p_brand)", "text"), "f_upper": ("=UPPER(p_name)", "upper(p_name)", "text"), "f_concat": ('=CONCAT(p_brand, "-", p_size)', "p_brand || '-' || p_size", "text"), "f_concatenate": ("=CONCATENATE(p_brand, p_type)", "p_brand || p_type", "text"), "f_textjoin": ('=TEXTJOIN("|", TRUE, p_brand, "", p_type)', "p_brand || '|' || p_type", "text"),
    "f_left": ("=LEFT(p_name, 3)", "left(p_name, 3)", "text"), "f_right": ("=RIGHT(p_name, 4)", "right(p_name, 4)", "text"), "f_mid": ("=MID(p_name, 2, 4)", "substr(p_name, 2, 4)", "text"), "f_replace": ('=REPLACE(p_name, 2, 3, "_")', "substr(p_name, 1, 1) || '_' || substr(p_name, 5)", "text"), "f_substitute": ('=SUBSTITUTE(p_name, "a", "4")', "replace(p_name, 'a', '4')", "text"), "f_rept": ("=REPT(p_brand, 2)", "repeat(p_brand, 2)", "text"),
    "f_exact": ("=EXACT(p_brand, UPPER(p_brand))", "p_brand = upper(p_brand)", "bool"), "f_find": ('=IFERROR(FIND("a", p_name), 0)', "position('a' IN p_name)"), "f_search": ('=IFERROR(SEARCH("A", p_name), 0)', "position('a' IN lower(p_name))"), "f_code": ("=CODE(p_name)", "unicode(p_name)"), "f_unicode": ("=UNICODE(p_brand)", "unicode(p_brand)"), "f_char": ("=CHAR(65 + MOD(p_size, 26))", "chr(65 + p_size % 26)", "text"), "f_unichar": ("=UNICHAR(960)", "'π'", "text"),
    "f_trim": ('=TRIM(CONCAT("  ", p_name, " "))', "p_name", "text"), "f_clean": ("=CLEAN(CONCAT(p_name, CHAR(7)))", "p_name", "text"), "f_t": ("=T(p_name)", "p_name", "text"), "f_phonetic": ("=PHONETIC(p_name)", "p_name", "text"), "f_valuetotext": ("=VALUETOTEXT(p_brand, 1)", "'\"' || p_brand || '\"'", "text"), "f_asc": ("=ASC(JIS(p_brand))", "p_brand", "text"), "f_leftb": ("=LEFTB(p_name, 3)", "left(p_name, 3)", "text"),
    "f_before": ('=IFERROR(TEXTBEFORE(p_name, " "), p_name)', "split_part(p_name, ' ', 1)", "text"), "f_after": ('=IFERROR(TEXTAFTER(p_name, " "), "")', "CASE WHEN position(' ' IN p_name) > 0 THEN substr(p_name, position(' ' IN p_name) + 1) ELSE '' END", "text"), "f_split": ('=TEXTSPLIT(p_name, " ")', "split_part(p_name, ' ', 1)", "text"), "f_encode": ('=ENCODEURL(p_type)', "replace(p_type, ' ', '%20')", "text"),
    "f_roman": ("=ROMAN(10)", "'X'", "text"), "f_arabic": ("=ARABIC(ROMAN(p_size))", "p_size"), "f_midb": ("=MIDB(p_brand, 2, 3)", "substr(p_brand, 2, 3)", "text"), "f_findb": ('=IFERROR(FINDB("a", p_name), 0)', "position('a' IN p_name)"), "f_rightb": ("=RIGHTB(p_name, 2)", "right(p_name, 2)", "text"), "f_replaceb": ('=REPLACEB(p_name, 1, 2, "")', "substr(p_name, 3)", "text"),
})
rows_query("text_numbers", "customer", ["c_custkey"], {
    "f_fixed": ("=FIXED(c_acctbal, 1)", "CASE WHEN floor(abs(c_acctbal) * 10 + 0.5) > 0 AND c_acctbal < 0 THEN '-' ELSE '' END || format('{:,.1f}', floor(abs(c_acctbal) * 10 + 0.5) / 10)", "text"), "f_dollar": ("=DOLLAR(ABS(c_acctbal), 0)", "'$' || format('{:,.0f}', floor(abs(c_acctbal) + 0.5))", "text"), "f_numbervalue": ('=NUMBERVALUE("1.250,5", ",", ".") + c_custkey', "1250.5 + c_custkey"),
    "f_text0": ('=TEXT(ABS(c_acctbal), "0.0")', "format('{:.1f}', floor(abs(c_acctbal) * 10 + 0.5) / 10)", "text"), "f_textpad": ('=TEXT(c_custkey, "00000000")', "lpad(c_custkey::VARCHAR, 8, '0')", "text"), "f_tostring": ('=CONCAT(c_custkey, "/", c_nationkey)', "c_custkey || '/' || c_nationkey", "text"),
})

# Dates

_o = "o_orderdate::DATE"
rows_query("date_parts", "orders", ["o_orderkey"], {
    "f_year": ("=YEAR(o_orderdate)", "year(o_orderdate)"), "f_month": ("=MONTH(o_orderdate)", "month(o_orderdate)"), "f_day": ("=DAY(o_orderdate)", "day(o_orderdate)"), "f_weekday": ("=WEEKDAY(o_orderdate)", "dayofweek(o_orderdate) + 1"), "f_weekday2": ("=WEEKDAY(o_orderdate, 2)", "isodow(o_orderdate)"), "f_isoweek": ("=ISOWEEKNUM(o_orderdate)", "weekofyear(o_orderdate)"),
    "f_weeknum": ("=WEEKNUM(o_orderdate)", "(dayofyear(o_orderdate) - 1 + dayofweek(make_date(year(o_orderdate), 1, 1))) // 7 + 1"), "f_serial": ("=o_orderdate + 0", "epoch(o_orderdate) / 86400 + 25569"), "f_date": ("=DATE(YEAR(o_orderdate), MONTH(o_orderdate) + 14, 1) + 0", f"date_diff('day', DATE '1899-12-30', (make_date(year({_o}), 1, 1) + to_months((month({_o}) + 13)::INT))::DATE)"), "f_datevalue": ('=DATEVALUE("2024-02-29") - DAY(o_orderdate)', "45351 - day(o_orderdate)"),
    "f_edate": ("=EDATE(o_orderdate, 1) + 0", f"date_diff('day', DATE '1899-12-30', ({_o} + INTERVAL 1 MONTH)::DATE)"), "f_eomonth": ("=EOMONTH(o_orderdate, -1) + 0", f"date_diff('day', DATE '1899-12-30', last_day({_o} - INTERVAL 1 MONTH))"), "f_days": ('=DAYS(o_orderdate, "1995-01-01")', f"date_diff('day', DATE '1995-01-01', {_o})"), "f_text": ('=TEXT(o_orderdate, "yyyy-mm-dd")', f"strftime({_o}, '%Y-%m-%d')", "text"),
})
rows_query("date_spans", "orders", ["o_orderkey"], {
    "f_d": ('=DATEDIF(o_orderdate, "2001-06-15", "D")', f"abs(date_diff('day', {_o}, DATE '2001-06-15'))"), "f_m": ('=DATEDIF("1990-01-10", o_orderdate, "M")', f"date_sub('month', DATE '1990-01-10', {_o})"), "f_y": ('=DATEDIF("1990-01-10", o_orderdate, "Y")', f"date_sub('month', DATE '1990-01-10', {_o}) // 12"), "f_ym": ('=DATEDIF("1990-01-10", o_orderdate, "YM")', f"date_sub('month', DATE '1990-01-10', {_o}) % 12"),
    "f_days360": ('=DAYS360("1990-01-10", o_orderdate, TRUE)', f"(year({_o}) - 1990) * 360 + (month({_o}) - 1) * 30 + least(day({_o}), 30) - 10"), "f_frac3": ('=YEARFRAC("1990-01-10", o_orderdate, 3)', f"date_diff('day', DATE '1990-01-10', {_o}) / 365.0::DOUBLE"), "f_frac2": ('=YEARFRAC("1990-01-10", o_orderdate, 2)', f"date_diff('day', DATE '1990-01-10', {_o}) / 360.0::DOUBLE"),
    "f_networkdays": ('=NETWORKDAYS(o_orderdate, EDATE(o_orderdate, 1))', f"(SELECT count(*) FILTER (WHERE isodow(g) < 6) FROM (SELECT unnest(generate_series({_o}, ({_o} + INTERVAL 1 MONTH)::DATE, INTERVAL 1 DAY)) AS g))"), "f_networkintl": ('=NETWORKDAYS.INTL(o_orderdate, EDATE(o_orderdate, 1), 11)', f"(SELECT count(*) FILTER (WHERE isodow(g) < 7) FROM (SELECT unnest(generate_series({_o}, ({_o} + INTERVAL 1 MONTH)::DATE, INTERVAL 1 DAY)) AS g))"),
    "f_workday": ("=WORKDAY(o_orderdate, 5) - o_orderdate", f"CASE WHEN isodow({_o}) = 7 THEN 5 WHEN isodow({_o}) = 6 THEN 6 ELSE 7 END - (epoch(o_orderdate) / 86400 - floor(epoch(o_orderdate) / 86400))"), "f_workdayintl": ("=WORKDAY.INTL(o_orderdate, 0, 2) + 0", f"date_diff('day', DATE '1899-12-30', {_o})"),
})
rows_query("time_parts", "events", ["event_id"], {
    "f_hour": ("=HOUR(ts)", "floor(floor((epoch_us(ts) % 86400000000) / 1e6 + 0.5) / 3600)"), "f_minute": ("=MINUTE(ts)", "floor((floor((epoch_us(ts) % 86400000000) / 1e6 + 0.5)::BIGINT % 3600) / 60)"), "f_second": ("=SECOND(ts)", "floor((epoch_us(ts) % 86400000000) / 1e6 + 0.5)::BIGINT % 60"), "f_time": ("=TIME(1, 30, 0)", "0.0625"), "f_timevalue": ('=TIMEVALUE("06:00")', "0.25"),
})

# Finance

rows_query("finance_cashflows", "lineitem", LINE, {
    "f_pv": ("=PV(0.01, l_quantity, -100)", "100 * (pow(1.01, l_quantity) - 1) / 0.01 / pow(1.01, l_quantity)"), "f_fv": ("=FV(0.01, l_quantity, -100)", "100 * (pow(1.01, l_quantity) - 1) / 0.01"), "f_pmt": ("=PMT(0.01, l_quantity, l_extendedprice)", f"-{_x} * pow(1.01, l_quantity) * 0.01 / (pow(1.01, l_quantity) - 1)"),
    "f_nper": ("=NPER(0.01, -l_extendedprice, 10 * l_extendedprice)", "ln((-1) / (-1 + 10 * 0.01)) / ln(1.01)"), "f_sum": ("=IPMT(0.01, 1, l_quantity, 1000) + PPMT(0.01, 1, l_quantity, 1000)", "-1000 * pow(1.01, l_quantity) * 0.01 / (pow(1.01, l_quantity) - 1)"), "f_ipmt": ("=IPMT(0.01, 1, l_quantity, 1000)", "-10"), "f_ispmt": ("=ISPMT(0.1, 1, l_quantity, 1000)", "-100 * (1 - 1 / l_quantity)"),
    "f_pduration": ("=PDURATION(0.05, 100, 100 + l_quantity)", "ln((100 + l_quantity) / 100) / ln(1.05)"), "f_rri": ("=RRI(l_quantity, 100, 300)", "pow(3, 1 / l_quantity) - 1"), "f_nominal": ("=NOMINAL(0.05, 4)", "4 * (pow(1.05, 0.25) - 1)"), "f_effect": ("=EFFECT(0.05, l_linenumber)", "pow(1 + 0.05 / l_linenumber, l_linenumber) - 1"), "f_sln": ("=SLN(l_extendedprice, 100, 5)", f"({_x} - 100) / 5"), "f_syd": ("=SYD(l_extendedprice, 100, 5, 2)", f"({_x} - 100) * 4 * 2 / 30"),
    "f_ddb": ("=DDB(1000 + l_extendedprice, 100, 5, 1)", f"(1000 + {_x}) * 0.4"), "f_db": ("=DB(1000, 100, 6, 1)", "319"), "f_dollarde": ("=DOLLARDE(1.02, 16)", "1.125"), "f_dollarfr": ("=DOLLARFR(1.125, 16)", "1.02"), "f_rate": ("=ROUND(RATE(12, -100, 1000), 6)", "0.029229"),
    "f_convert": ('=CONVERT(l_quantity, "ft", "m")', "l_quantity * 0.3048"), "f_duration": ('=DURATION("2020-01-01", "2021-12-21", 0.08, 0.08, 1)', "1.9259259259259258"), "f_vdb": ("=VDB(1000 + l_quantity, 0, 4, 0, 4)", "1000 + l_quantity"), "f_yieldmat": ('=YIELDMAT("2020-01-01", "2020-12-26", "2020-01-01", 0.05, 100)', "0.05"),
    "f_disc": ('=DISC("2024-01-01", "2024-12-26", 95, 100)', "0.05"), "f_intrate": ('=INTRATE("2024-01-01", "2024-12-26", 100, 110)', "0.1"), "f_yielddisc": ('=YIELDDISC("2024-01-01", "2024-12-26", 80, 100)', "0.25"), "f_accrintm": ('=ACCRINTM("2024-01-01", "2024-12-26", 0.1, 500)', "50"),
})

_Z = "(p_size / 25.0::DOUBLE)"
rows_query("distributions", "part", ["p_partkey"], {
    "f_poisson": ("=POISSON.DIST(3, (MOD(p_size, 7) + 1), FALSE)", "exp(-(p_size % 7 + 1)) * pow((p_size % 7 + 1), 3) / 6"), "f_binom": ("=BINOM.DIST(1, (MOD(p_size, 7) + 1), 0.3, FALSE)", "(p_size % 7 + 1) * 0.3 * pow(0.7, (p_size % 7 + 1) - 1)"), "f_negbinom": ("=NEGBINOM.DIST((MOD(p_size, 7) + 1), 1, 0.3, FALSE)", "0.3 * pow(0.7, (p_size % 7 + 1))"),
    "f_gamma": ("=GAMMA.DIST((p_size / 600), 1, 2, TRUE)", "1 - exp(-(p_size / 600.0::DOUBLE) / 2)"), "f_gammaln": ("=GAMMALN(p_size)", "lgamma(p_size)"), "f_chisq": ("=CHISQ.DIST.RT(p_size, 2)", "exp(-p_size / 2)"), "f_chisqinv": ("=CHISQ.INV.RT(0.05 + (p_size / 600), 2)", "-2 * ln(0.05 + (p_size / 600.0::DOUBLE))"), "f_beta": ("=BETA.DIST((p_size / 600), 2, 1, TRUE)", "(p_size / 600.0::DOUBLE) * (p_size / 600.0::DOUBLE)"),
    "f_betainv": ("=BETA.INV(0.1 + (p_size / 600), 2, 1)", "sqrt(0.1 + (p_size / 600.0::DOUBLE))"), "f_tdist": ("=T.DIST(p_size / 10, 1, TRUE)", "0.5 + atan(p_size / 10) / pi()"), "f_tinv": ("=T.INV(0.6 + (p_size / 600), 1)", "tan(pi() * (0.1 + (p_size / 600.0::DOUBLE)))"), "f_fdist": ("=F.DIST.RT(p_size, 2, 2)", "1 / (1 + p_size)"), "f_normpdf": ("=NORM.DIST(p_size, 25, 5, FALSE)", "exp(-pow((p_size - 25) / 5, 2) / 2) / (5 * sqrt(2 * pi()))"),
    "f_norminv": ("=NORM.S.INV(NORM.S.DIST(p_size / 25, TRUE))", _Z), "f_lognorm": ("=LOGNORM.DIST(LOGNORM.INV(0.2 + (p_size / 600), 1, 2), 1, 2, TRUE)", "0.2 + (p_size / 600.0::DOUBLE)"), "f_hypgeom": ("=HYPGEOM.DIST(1, 1, (MOD(p_size, 7) + 1), 10, FALSE)", "(p_size % 7 + 1) / 10.0"), "f_gauss": ("=GAUSS((p_size / 600)) + GAUSS(-(p_size / 600))", "0"), "f_erf": ("=ERF((p_size / 600)) + ERFC((p_size / 600))", "1"),
})
rows_query("complex_numbers", "part", ["p_partkey"], {
    "f_complex": ("=COMPLEX(p_size, 1)", "p_size || '+i'", "text"), "f_imabs": ('=IMABS(COMPLEX(3 * p_size, 4 * p_size))', "5 * p_size"), "f_imreal": ('=IMREAL(COMPLEX(p_size, 2))', "p_size"), "f_imaginary": ('=IMAGINARY(COMPLEX(p_size, -2))', "-2"), "f_imsum": ('=IMSUM(COMPLEX(p_size, 1), "2-i")', "(p_size + 2)::VARCHAR", "text"), "f_imsub": ('=IMSUB(COMPLEX(p_size, 1), "i")', "p_size::VARCHAR", "text"),
    "f_improduct": ('=IMPRODUCT(COMPLEX(0, p_size), "i")', "(-p_size)::VARCHAR", "text"), "f_imdiv": ('=IMDIV(COMPLEX(0, p_size), "i")', "p_size::VARCHAR", "text"), "f_imconjugate": ("=IMCONJUGATE(COMPLEX(p_size, 2))", "p_size || '-2i'", "text"), "f_imargument": ("=IMARGUMENT(COMPLEX(p_size, p_size))", "pi() / 4"), "f_imexp": ("=IMREAL(IMEXP(COMPLEX(0, p_size)))", "cos(p_size)"), "f_imsqrt": ("=IMREAL(IMSQRT(COMPLEX(p_size, 0)))", "sqrt(p_size)"),
    "f_imln": ("=IMREAL(IMLN(COMPLEX(p_size, 0)))", "ln(p_size)"), "f_imsin": ("=IMREAL(IMSIN(COMPLEX(p_size, 0)))", "sin(p_size)"), "f_imcos": ("=IMREAL(IMCOS(COMPLEX(p_size, 0)))", "cos(p_size)"), "f_imtan": ("=IMREAL(IMTAN(COMPLEX(p_size, 0)))", "tan(p_size)"), "f_impower": ("=IMREAL(IMPOWER(COMPLEX(p_size, 0), 2))", "p_size * p_size"), "f_imlog10": ("=IMREAL(IMLOG10(COMPLEX(p_size, 0)))", "log10(p_size)"),
})
groups_query("agg_tests", "lineitem", ["l_returnflag"], {
    "f_ztest": ("=ROUND(Z.TEST(l_quantity, 25.5, 1000000) * 2, 1)", "1"), "f_ttest": ("=T.TEST(l_quantity, l_quantity, 2, 2)", "1"), "f_ftest": ("=F.TEST(l_quantity, l_quantity)", "1"), "f_chitest": ("=CHISQ.TEST(l_quantity, l_quantity)", "1"),
})


def queries() -> dict[str, Query]:
    from tabulon import queries_formulas, queries_sources, queries_tables  # noqa: F401  register their queries

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
