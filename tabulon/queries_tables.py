"""Queries of table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import aggregates as agg
from tabulon.functions import documents as doc
from tabulon.functions.values import of_column
from tabulon.operators import tables as op
from tabulon.queries import query, read, rounded


@query("SELECT o_orderkey, c_name, coalesce(n_name, 'none') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_xlookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = op.lookup(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", read(spark, sf_dir, "customer"), "c_custkey", {"c_name": "c_name", "c_nationkey": "c_nationkey"}, ["c_name"])
    return op.lookup(o, "c_nationkey", read(spark, sf_dir, "nation"), "n_nationkey", {"nation": "n_name"}, ["n_name"], {"nation": "none"}).select("o_orderkey", "c_name", "nation")


@query("SELECT c_custkey, first_order FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_order FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def lookup_vlookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lookup(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", read(spark, sf_dir, "orders"), "o_custkey", {"first_order": "o_totalprice"}, ["o_orderkey"])


@query("SELECT c_custkey, (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = c_nationkey % 5) AS at FROM customer")
def lookup_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("v"))
    return op.match(c, "v", read(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "at").drop("v")


@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, p_brand, p_type FROM part) UNPIVOT (value FOR name IN (p_brand, p_type))")
def lookup_hlookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.transposed(read(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.has_match(read(spark, sf_dir, "customer"), "c_custkey", read(spark, sf_dir, "orders"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lacks_match(read(spark, sf_dir, "customer"), "c_custkey", read(spark, sf_dir, "orders"), "o_custkey").select("c_custkey")


_CRITERIA = [{"l_quantity": ">=40", "l_linestatus": "F"}, {"l_discount": "0.1", "l_returnflag": "<>R"}]
_D = {"DSUM": "sum({f})", "DAVERAGE": "avg({f})", "DPRODUCT": "product({f})", "DSTDEV": "stddev_samp({f})", "DSTDEVP": "stddev_pop({f})", "DVAR": "var_samp({f})", "DVARP": "var_pop({f})", "DMAX": "max({f})", "DMIN": "min({f})", "DCOUNT": "count({f})", "DCOUNTA": "count({f})"}


@query("SELECT l_shipmonth, " + ", ".join(f"round(CAST({s.format(f='l_tax + 1' if k == 'DPRODUCT' else 'l_quantity')} AS DOUBLE), 6) + 0.0 AS {k.lower()}" for k, s in _D.items()) + " FROM (SELECT *, month(l_shipdate)::INT AS l_shipmonth FROM lineitem) WHERE (l_quantity >= 40 AND l_linestatus = 'F') OR (l_discount = 0.1 AND l_returnflag <> 'R') GROUP BY 1")
def database_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate")).withColumn("t", F.col("l_tax") + 1)
    fields = {k.lower(): (k, "t" if k == "DPRODUCT" else "l_quantity") for k in _D}
    return rounded(op.database(li, _CRITERIA, fields, ["l_shipmonth"]), list(fields))


@query("SELECT CASE WHEN count(*) = 1 THEN any_value(p_name) END AS dget FROM part WHERE p_partkey = 7")
def database_dget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.database(read(spark, sf_dir, "part"), [{"p_partkey": "=7"}], {"dget": ("DGET", "p_name")})


@query('SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = \'F\' THEN l_quantity END), 6) AS "F", round(sum(CASE WHEN l_linestatus = \'O\' THEN l_quantity END), 6) AS "O" FROM lineitem WHERE l_tax > 0.01 GROUP BY 1')
def pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.pivot(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], "l_quantity", "sum", F.col("l_tax") > 0.01), ["F", "O"])


_MEASURES = {"total": ("sum", "l_quantity"), "mean": ("average", "l_tax"), "n": ("count", "l_tax"), "top": ("max", "l_extendedprice"), "low": ("min", "l_extendedprice"), "sd": ("stdDev", "l_quantity"), "sdp": ("stdDevp", "l_quantity"), "v": ("var", "l_quantity"), "vp": ("varp", "l_quantity")}


@query("SELECT l_returnflag, l_linestatus, (grouping(l_returnflag) + grouping(l_linestatus))::INT AS level, round(sum(l_quantity), 6) AS total, round(avg(l_tax), 6) AS mean, count(l_tax) AS n, round(max(l_extendedprice), 6) AS top, round(min(l_extendedprice), 6) AS low, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def pivot_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.subtotals(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], _MEASURES), list(_MEASURES))


@query("SELECT l_returnflag, l_linestatus, (grouping(l_returnflag) + grouping(l_linestatus))::INT AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def pivot_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.subtotals(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": ("count", "l_tax")}, cube=True)


@query("SELECT c_nationkey, c_mktsegment, round(s, 6) AS s, round(s / sum(s) OVER (PARTITION BY c_nationkey), 6) AS share FROM (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS s FROM customer GROUP BY 1, 2)")
def pivot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("s"))
    return rounded(op.show_as_share(s, "s", ["c_nationkey"]), ["s", "share"])


@query("SELECT n_name, n_nationkey, false AS is_total FROM nation UNION ALL SELECT 'Total', max(n_nationkey), true FROM nation")
def table_totals_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_totals_row(read(spark, sf_dir, "nation").select("n_name", "n_nationkey"), {"n_nationkey": "max"}, "Total")


@query("SELECT l_orderkey, l_linenumber, r AS rank_eq, r + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank_avg FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS r FROM lineitem)")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rank(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "rank_eq", "rank_avg")


@query("SELECT o_orderkey, floor((r - 1) / (n - 1.0::DOUBLE) * 1000 + 1e-9) / 1000 AS rank_inc, floor(r / (n + 1.0::DOUBLE) * 1000 + 1e-9) / 1000 AS rank_exc FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)")
def ranking_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.percent_rank(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", "rank_inc", "rank_exc")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_acctbal DESC, c_custkey LIMIT 40")
def sort_custom_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    keys = [op.sort_key(c, "c_mktsegment", custom=["MACHINERY", "BUILDING"]), op.sort_key(c, "c_acctbal", descending=True), op.sort_key(c, "c_custkey")]
    return op.top(c, 40, keys)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_quantity <= 2) AND l_returnflag <> 'N'")
def filter_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.auto_filter(read(spark, sf_dir, "lineitem"), {"l_quantity": (">45", "<=2"), "l_returnflag": ("<>N",)}, {"l_quantity": True}).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, rule FROM (SELECT p_partkey, unnest([CASE WHEN NOT p_size BETWEEN 5 AND 45 THEN 'size' END, CASE WHEN NOT p_retailprice > 950 THEN 'price' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12') THEN 'brand' END]) AS rule FROM part) WHERE rule IS NOT NULL")
def filter_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"size": ("p_size", "between", 5, 45), "price": ("p_retailprice", "greaterThan", 950), "brand": ("p_brand", "list", ["Brand#11", "Brand#12"])}
    return op.violations(read(spark, sf_dir, "part"), rules).select("p_partkey", "rule")


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS scale, CASE WHEN p_size >= 40 THEN 'up' WHEN p_size >= 15 THEN 'flat' ELSE 'down' END AS icon FROM part")
def format_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = op.color_scale(read(spark, sf_dir, "part"), "p_retailprice").withColumn("icon", op.icon_set(F.col("p_size"), [15, 40], ["down", "flat", "up"]))
    return rounded(p.select("p_partkey", "scale", "icon"), ["scale"])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.find_text(read(spark, sf_dir, "documents"), "text", "License", ignore_case=True).select("doc_id")


@query("SELECT n_nationkey::BIGINT AS row, col, value FROM (SELECT n_nationkey, unnest([{'col': 1, 'value': n_name}, {'col': 2, 'value': n_regionkey::VARCHAR}], recursive := true) FROM nation) WHERE n_nationkey BETWEEN 3 AND 9 AND col BETWEEN 1 AND 2")
def range_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumn("row", F.col("n_nationkey").cast("long"))
    return op.cell_range(op.cells(n, "row", ["n_name", "n_regionkey"]), 9, 2, 3, 1)


@query("SELECT min(n_nationkey)::BIGINT AS first_row, 1 AS first_col, max(n_nationkey)::BIGINT AS last_row, 2 AS last_col FROM nation")
def range_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumn("row", F.col("n_nationkey").cast("long"))
    return op.used_range(op.cells(n, "row", ["n_name", "n_regionkey"]))


@query("SELECT n_name AS name, n_nationkey AS key FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def stack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.vstack(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")))


@query("SELECT (n_nationkey // 4)::BIGINT AS row, max(CASE WHEN n_nationkey % 4 = 0 THEN n_name END) AS c1, max(CASE WHEN n_nationkey % 4 = 1 THEN n_name END) AS c2, max(CASE WHEN n_nationkey % 4 = 2 THEN n_name END) AS c3, max(CASE WHEN n_nationkey % 4 = 3 THEN n_name END) AS c4 FROM nation GROUP BY 1")
def wrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.wrap_rows(read(spark, sf_dir, "nation"), "n_nationkey", "n_name", 4)


@query("SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT l_suppkey AS node, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT l_partkey, 0, 1 FROM lineitem) GROUP BY 1")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.degrees(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


_flow = lambda df: of_column(F.col("v"), df.schema["v"].dataType)


@query("SELECT o_custkey, round(sum(v / pow(1.05, i)), 4) AS npv, round(sum(v / pow(1.05, d / 365.0::DOUBLE)), 4) AS xnpv FROM (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) AS d FROM orders) GROUP BY 1")
def finance_npv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice"))
    dates = of_column(F.to_date("o_orderdate"), o.withColumn("d", F.to_date("o_orderdate")).schema["d"].dataType)
    out = o.groupBy("o_custkey").agg(agg.npv(0.05, _flow(o), F.col("o_orderkey")).alias("npv"), agg.xnpv(0.05, _flow(o), dates).alias("xnpv"))
    return rounded(out, ["npv", "xnpv"], 4)


@query()
def finance_irr(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 2))
    return rounded(o.groupBy("o_custkey").agg(agg.irr(_flow(o), F.col("o_orderkey")).alias("irr"), agg.mirr(_flow(o), F.col("o_orderkey"), 0.1, 0.12).alias("mirr")), ["irr", "mirr"])


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END::INT AS words, length(text)::INT AS characters, length(regexp_replace(text, '\\s', '', 'g'))::INT AS characters_no_spaces, len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''))::INT AS paragraphs, ceil(length(text) / 80)::BIGINT AS lines, greatest(ceil(ceil(length(text) / 80) / 46), 1)::BIGINT AS pages FROM documents")
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in doc.statistics(F.col("text")).items()])


@query("SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def markdown_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.conversation_markdown(read(spark, sf_dir, "conversations"))


@query("SELECT n_regionkey, '| ' || (SELECT '') || 'name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    head = n.select("n_regionkey").distinct().select("n_regionkey", F.lit(-1).alias("row"), F.explode(F.array(F.struct(F.lit(1).alias("col"), F.lit("name").alias("text")), F.struct(F.lit(2).alias("col"), F.lit("key").alias("text")))).alias("c")).select("n_regionkey", "row", "c.col", "c.text")
    body = n.select("n_regionkey", F.col("n_nationkey").alias("row"), F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("n_name").alias("text")), F.struct(F.lit(2).alias("col"), F.col("n_nationkey").cast("string").alias("text")))).alias("c")).select("n_regionkey", "row", "c.col", "c.text")
    return doc.table_markdown(head.unionByName(body), ["n_regionkey"])


@query("SELECT page_id, CASE WHEN starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') THEN 'html' WHEN starts_with(lower(ltrim(html)), '<?xml') THEN 'xml' ELSE 'text' END AS format FROM pages")
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", doc.detect_format(F.col("html").cast("binary")).alias("format"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.streaming.windows import hourly

    return rounded(hourly(read(spark, sf_dir, "events")), ["total"], 4)
