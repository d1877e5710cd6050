import math

import pandas as pd
import pytest

from tabulon.functions import criteria, special
from tabulon.plans import formula as fx


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [(1, 10.0, "apple", True, None), (2, -2.5, "Banana", False, ""), (3, 0.0, None, None, "x"), (4, 7.0, "5", True, "y")]
    return spark.createDataFrame(rows, "id int, n double, s string, b boolean, e string")


def one(spark, f):
    r = fx.calculate(spark.range(1), {"v": f}, errors=True).first()
    return r["v_err"] if r["v_err"] is not None else r["v"]


@pytest.mark.parametrize("f,want", [
    ("=1+2*3", 7.0), ("=-(2+3)*2", -10.0), ("=1/0", "Division by zero"), ("=\"a\"+1", "#VALUE!"), ("=1=1", True), ('="a"<"B"', False), ("=ROUND(1.005,2)", 1.0), ("=ROUND(-2.5,0)", -3.0), ("=MOD(-7,3)", 2.0), ("=MOD(1,0)", "#NUM!"), ("=FLOOR(5,0)", "#NUM!"),
    ("=IF(FALSE,1/0,5)", 5.0), ("=IFERROR(1/0,9)", 9.0), ("=IFERROR(NA(),\"n\")", "n"), ("=IFNA(1/0,9)", "Division by zero"), ("=ISNA(NA())", True), ("=ISERR(NA())", False), ("=IF(\"FALSE\",1,2)", 1.0), ("=LN(0)", -math.inf), ("=EVEN(-1)", -2.0), ("=ODD(0)", 1.0),
    ("=PROPER(\"o'neil ab1c\")", "O'Neil Ab1C"), ('=SUBSTITUTE("a-b-c","-","+",2)', "a-b+c"), ('=TEXTBEFORE("a-b-c","-",-1)', "a-b"), ('=TEXTAFTER("a-b-c","-",2)', "c"), ('=TEXTAFTER("abc","-")', "#N/A"), ('=REPLACE("abc",9,1,"z")', "abc"), ('=FIND("","a")', "#VALUE!"),
    ('=TEXT(1234.567,"#,##0.00")', "1,234.57"), ('=TEXT(0.256,"0%")', "26%"), ('=DOLLAR(-1)', "-$1.00"), ('=FIXED(1234.5,1,TRUE)', "1234.5"), ('=ROMAN(1994)', "MCMXCIV"), ('=ARABIC("-XIV")', -14.0), ('=LEFTB("日本x",3)', "日"), ('=NUMBERVALUE("1,5",",")', 1.5), ('=NUMBERVALUE("1x")', "#VALUE!"),
    ("=DEC2BIN(-3)", "1111111101"), ("=HEX2DEC(\"FFFFFFFFFF\")", -1.0), ("=BIN2DEC(\"102\")", "#NUM!"), ("=DEC2HEX(10,1)", "A"), ("=BITLSHIFT(3,2)", 12.0), ("=GCD(12,18)", 6.0), ("=LCM(4,6)", 12.0), ("=COMBIN(5,2)", 10.0), ("=FACT(5)", 120.0),
    ("=TIME(25,0,0)", "#VALUE!"), ('=DATEDIF("2024-01-31","2024-03-01","M")', 1.0), ('=WORKDAY("2024-03-01",1)-DATEVALUE("2024-03-01")', 3.0), ('=NETWORKDAYS("2024-03-01","2024-03-31")', 21.0), ('=NETWORKDAYS("2024-03-10","2024-03-01")', -6.0), ('=ISOWEEKNUM("2021-01-03")', 53.0), ('=EOMONTH("2024-01-15",1)-0', 45351.0),
    ("=PDURATION(0.1,1000,2000)", 7.272540897341713), ("=RRI(10,1000,2000)", 0.07177346253629314), ("=PMT(0,10,1000)", -100.0), ("=SLN(10,1,0)", "Division by zero"), ("=DB(1000000,100000,6,1)", 319000.0), ("=DDB(2400,300,10,2)", 384.0), ("=DOLLARDE(1.02,16)", 1.125),
    ('=CONVERT(1,"mi","km")', 1.609344), ('=CONVERT(212,"F","C")', 100.0), ('=CONVERT(1,"kg","m")', "#N/A"), ("=VDB(2400,300,10,0,1)", 480.0), ("=VDB(1000,0,4,0,4)", 1000.0), ('=DURATION("2020-01-01","2021-12-21",0.08,0.08,1)', 1.9259259259259258),
    ('=YIELD("2020-01-01","2021-12-21",0.08,100,100,2)', 0.08), ('=YIELDMAT("2020-01-01","2020-12-26","2020-01-01",0.05,100)', 0.05), ('=ROUND(VALUE("1e2"),0)', 100.0),
    ("=NORM.S.DIST(1.96,TRUE)", 0.9750021048517795), ("=NORM.S.INV(2)", "#NUM!"), ("=IMSUM(\"1+2i\",\"3-i\")", "4+i"), ("=IMABS(\"3+4i\")", 5.0), ("=IMPRODUCT(\"i\",\"i\")", "-1"), ("=COMPLEX(1,-1)", "1-i"), ("=CHOOSE(4,1,2)", "#VALUE!"), ("=SWITCH(3,1,\"a\")", "#N/A"), ("=TYPE(TRUE)", 4.0),
])
def test_scalars(spark, f, want):
    got = one(spark, f)
    assert got == pytest.approx(want, rel=1e-9) if isinstance(want, float) else got == want


def test_columns_and_errors(sheet):
    out = {r["id"]: r for r in fx.calculate(sheet, {"x": "=10/[@n]", "t": "=IF(ISTEXT(s),UPPER(s),\"none\")", "k": "=IFERROR(n+s,-1)", "z": "=ISBLANK(e)"}, errors=True).collect()}
    assert out[3]["x"] is None and out[3]["x_err"] == "Division by zero" and out[1]["x"] == 1.0
    assert [out[i]["t"] for i in (1, 3)] == ["APPLE", "none"] and out[4]["k"] == -1.0 and [out[i]["z"] for i in (1, 2, 3)] == [True, True, False]


def test_aggregates(sheet):
    r = fx.summarize(sheet, {"a": "=SUM(n,id)", "c": "=COUNT(s)", "ca": "=COUNTA(s)", "cb": "=COUNTBLANK(e)", "av": "=AVERAGEA(b)", "m": "=MIN(s)", "i": '=COUNTIF(s,"*an*")', "n5": '=COUNTIF(s,5)', "ne": '=COUNTIF(n,"<>7")', "bad": '=IFERROR(AVERAGEIF(n,">99"),-1)', "and_": "=AND(b)", "s2": "=SUM(n)/COUNT(n)"}).first()
    assert r.asDict() == {"a": 24.5, "c": 0.0, "ca": 3.0, "cb": 2.0, "av": 2 / 3, "m": 0.0, "i": 1.0, "n5": 0.0, "ne": 3.0, "bad": -1.0, "and_": False, "s2": 14.5 / 4}
    assert fx.summarize(sheet.where("id > 9"), {"s": "=SUM(n)", "p": "=PRODUCT(n)", "v": "=AVERAGE(n)"}).first().asDict() == {"s": 0.0, "p": 0.0, "v": None}


@pytest.mark.parametrize("bad", ["=1+", "=FOO(1)", "=nope", "=(1", "=1 2", '="x'])
def test_bad_formulas(spark, bad):
    with pytest.raises(fx.FormulaError):
        fx.calculate(spark.range(1), {"v": bad})


def test_criteria():
    assert criteria.parse(">= 5") == (">=", 5.0) and criteria.parse("<>") == ("<>", "") and criteria.parse("a=b") == ("=", "a=b")


def test_special_functions():
    assert special.gamma_p(2, 3) == pytest.approx(0.8008517265285442) and special.beta_i(2, 3, 0.4) == pytest.approx(0.5248) and special.t_cdf(2, 10) == pytest.approx(0.9633059826146299)
    assert special.f_cdf(4.0, 1, 8) == pytest.approx(2 * special.t_cdf(2, 8) - 1) and special.f_cdf(0, 3, 10) == 0 and special.irr([-100, 60, 60]) == pytest.approx(0.13066, abs=1e-5)
    for name, p in (("CHISQ", (0.3, 4.0)), ("T", (0.8, 7.0)), ("F", (0.6, 3.0, 9.0))):
        x = special.NUMERIC[f"{name}.INV"][0](*p)
        assert special.NUMERIC[f"{name}.DIST"][0](x, *p[1:], 1.0) == pytest.approx(p[0])
    assert special.format_complex(*special.parse_complex("-2.5-j")) == "-2.5-j" and special.parse_complex("x") is None and len(fx.supported()) > 350


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(1, "b", 2.0, 10), (2, "a", 3.0, 20), (3, "b", 9.0, 30), (4, None, 5.0, 40), (5, "7", 6.0, 50)]
    return fx.Table(spark.createDataFrame(rows, "at int, name string, price double, code int"), "at")


def looked_up(spark, prices, f):
    keys = spark.createDataFrame([(1, "a", 30.0), (2, "b", 20.0), (3, "z", 99.0), (4, None, None)], "id int, k string, c double")
    out = fx.calculate(keys, {"v": f}, errors=True, tables={"Prices": prices}, position="id").orderBy("id").collect()
    return [r["v_err"] if r["v_err"] is not None else r["v"] for r in out]


@pytest.mark.parametrize("f,want", [
    ("=VLOOKUP(k, Prices, 2)", [3.0, 2.0, "VLOOKUP: value not found", 5.0]), ("=VLOOKUP(k, Prices, 9)", ["VLOOKUP: column out of bounds"] * 4), ("=VLOOKUP(k, Prices, 2, TRUE)", ["VLOOKUP: exact matches only"] * 4), ("=XLOOKUP(k, Prices[name], Prices[code], -1)", [20.0, 10.0, -1.0, 40.0]),
    ('=XLOOKUP(k, Prices[name], Prices[price], "none")', ["3", "2", "none", "5"]), ("=XLOOKUP(c, Prices[code], Prices[name])", ["b", "a", "XLOOKUP: value not found", "XLOOKUP: value not found"]), ("=MATCH(k, Prices[name], 0)", [2.0, 1.0, "MATCH: value not found", 4.0]), ("=MATCH(7, Prices[name])", [5.0] * 4), ("=MATCH(k, Prices[name], 1)", ["MATCH: exact matches only"] * 4),
    ("=INDEX(Prices[name], ROW())", ["b", "a", "b", None]), ("=INDEX(Prices, 9, 1)", ["INDEX: row out of bounds"] * 4), ("=INDEX(Prices[price], MATCH(k, Prices[name], 0)) * 2", [6.0, 4.0, "MATCH: value not found", 10.0]), ('=HLOOKUP("price", Prices, 3)', [3.0] * 4), ('=HLOOKUP(k, Prices, 2)', ["HLOOKUP: value not found"] * 4),
    ("=COLUMN(c)", [3.0] * 4), ("=COLUMN([@k])", [2.0] * 4), ("=COLUMNS(Prices)", [3.0] * 4), ("=COLUMN(Prices[code])", [3.0] * 4), ("=ROW()", [1.0, 2.0, 3.0, 4.0]), ("=SHEETS()", [2.0] * 4), ('=SHEET("prices")', [2.0] * 4), ('=SHEET("none")', ["#N/A"] * 4), ("=Prices[[#Headers],[code]]", ["code"] * 4),
    ("=RANK(c, [c])", [2.0, 3.0, 1.0, "#VALUE!"]), ("=RANK.AVG(c, [c], 1)", [2.0, 1.0, 3.0, "#VALUE!"]), ("=RANK(c, Prices[code])", [3.0, 4.0, "#N/A", "#VALUE!"]), ("=PERCENTRANK([c], c)", [0.5, 0.0, 1.0, "#VALUE!"]), ("=IFERROR(VLOOKUP(k, Prices, 2) / 0, -1)", [-1.0] * 4), ("=VLOOKUP(k)", ["VLOOKUP: wrong number of arguments"] * 4),
])
def test_lookups_in_formulas(spark, prices, f, want):
    assert looked_up(spark, prices, f) == want


@pytest.mark.parametrize("f", ["=TDIST(1.96,60,2)", "=ROUND(1)", "=ROUND(1,2,3)", "=PI(1)", "=IF()", "=YEAR()", "=LEFT()", "=NORM.DIST(1)", "=IMSUB(\"1\")", "=CONVERT(1,\"m\")", "=YIELD(1,2)", "=DEC2BIN(1,2,3)"])
def test_a_wrong_number_of_arguments_is_an_error_in_band(spark, f):
    assert one(spark, f).endswith(": wrong number of arguments")
    assert one(spark, f"=IFERROR({f[1:]}, 5)") == 5.0


def test_later_formulas_use_earlier_ones(spark):
    out = fx.calculate(spark.range(3), {"a": "=id*2", "b": "=a+1", "c": "=IF(b>3,ROUND(a/b,1),\"low\")", "id": "=b"}).orderBy("a").collect()
    assert [(r["a"], r["b"], r["c"], r["id"]) for r in out] == [(0.0, 1.0, "low", 1.0), (2.0, 3.0, "low", 3.0), (4.0, 5.0, "0.8", 5.0)]


def test_literal_calls_need_no_python(spark):
    plan = fx.calculate(spark.range(3), {"a": "=RATE(12,-100,1000)", "b": "=NORM.S.INV(0.9)+id", "c": '=DURATION("2020-01-01","2021-12-21",0.08,0.08,1)', "d": "=VDB(id+10,0,4,0,4)", "e": '=IMSUM("1+i","2")'})
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.first()["e"] == "3+i"


def test_cash_flows_and_database_in_formulas(spark):
    df = spark.createDataFrame([(2, 60.0, "x"), (1, -100.0, "y"), (3, 60.0, "x")], "t int, v double, k string")
    f = {"npv": "=NPV(0.1,v)", "irr": "=IRR(v)", "d": '=DSUM([#All],"v",crit)', "n": "=DCOUNT([#All],2,crit)", "g": '=IFERROR(DGET([#All],"k",one),"-")', "two": '=IFERROR(DGET([#All],"v",crit),-1)', "bad": "=IFERROR(NPV(1),0)", "none": '=IFERROR(DMAX([#All],"v",nothing),-9)'}
    r = fx.summarize(df, f, names={"crit": [{"k": "x"}], "one": {"t": "<2"}, "nothing": [{"k": "q"}]}, order="t").first()
    assert r["npv"] == pytest.approx(-100 / 1.1 + 60 / 1.21 + 60 / 1.331) and r["irr"] == pytest.approx(special.irr([-100, 60, 60]))
    assert (r["d"], r["n"], r["g"], r["two"], r["bad"], r["none"]) == (120.0, 2.0, "y", -1.0, 0.0, -9.0)
    with pytest.raises(fx.FormulaError):
        fx.summarize(df, {"x": "=NPV(0.1,v)"})


def test_rates_that_newton_leaves_or_nulls_beside(spark):
    near_nothing, none = ([-300.0, 35.0], [0.0, 30.0]), ([-300.0, 3.0, 18.0], [900.0, 930.0, 960.0])
    assert special.xirr(*near_nothing) == pytest.approx((35 / 300) ** (365 / 30) - 1) and special.irr([5.0, 5.0]) is None
    assert special.xirr([-300.0, 798.0, 444.0], [0.0, 30.0, 2670.0]) == pytest.approx((798 / 300) ** (365 / 30) - 1, rel=1e-3)
    rows = [(k, v, d) for k, (values, days) in enumerate([near_nothing, none, ([-100.0, 60.0, 60.0, None, 7.0], [0.0, 365.0, 730.0, 800.0, None])]) for v, d in zip(values, days, strict=True)]
    df = spark.createDataFrame(rows, "k int, v double, d double")
    got = {r["k"]: (r["x"], r["n"]) for r in fx.summarize(df, {"x": "=XIRR(v,d)", "n": "=XNPV(0.1,v,d)"}, by=["k"], order="d").collect()}
    assert got[0][0] == pytest.approx(special.xirr(*near_nothing)) and got[2] == (pytest.approx(0.13066, abs=1e-5), pytest.approx(-100 + 60 / 1.1 + 60 / 1.21))


def test_equal_arguments_are_worked_out_once(spark):
    calls = []
    run = special.udf(lambda *x: calls.append(x) or math.copysign(1, x[0]) / x[1], "double", 2).func
    batch = [pd.Series([1.0, -0.0, 0.0, 1.0, float("nan"), -0.0, 1.0]), pd.Series([2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 0.0])]
    want = [0.5, -0.5, 0.5, 0.5, None, -0.5, None]
    for _ in range(2):
        assert [None if v != v else v for v in run(*batch)] == want
    assert len(calls) == 4 and run(pd.Series([], dtype=float), pd.Series([], dtype=float)).empty
    words = special.udf(lambda s, k: s * int(k), "string", 2).func
    assert words(pd.Series(["a", None, "b", "a"]), pd.Series([2, 2, 1, 1])).tolist() == ["aa", None, "b", "a"]


def test_random_numbers(spark):
    rows = fx.calculate(spark.range(200), {"a": "=RAND()", "b": "=RANDBETWEEN(2,4)"}).collect()
    assert all(0 <= r["a"] < 1 for r in rows) and {r["b"] for r in rows} == {2.0, 3.0, 4.0}
