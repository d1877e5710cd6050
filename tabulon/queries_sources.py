"""Queries that write files' bytes from the test tables and read them back, and formulas over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import documents as doc
from tabulon.plans import grid
from tabulon.queries import query, read, rounded
from tabulon.sources import readers, writers

_COLUMNS = ["c_custkey", "c_name", "c_acctbal"]


def _books(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A file of customers for each nation."""
    return writers.workbooks(read(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], _COLUMNS, kind)


def _records(cells: DataFrame) -> DataFrame:
    """Rows of the books from their cells, without the head."""
    value = lambda i: F.max(F.when(F.col("col") == i, F.col("value")))
    rows = cells.where("row > 1").groupBy("path", "row").agg(value(1).cast("long").alias("c_custkey"), value(2).alias("c_name"), F.round(value(3).cast("double"), 2).alias("c_acctbal"))
    return rows.select(F.split("path", r"\.")[0].cast("int").alias("nation"), "row", "c_custkey", "c_name", "c_acctbal")


_BOOKS = "SELECT c_nationkey::INT AS nation, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1)::INT AS row, c_custkey::BIGINT AS c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer"


def _source(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _records(readers.read_content(_books(spark, sf_dir, kind), kind))

    run.__name__ = f"source_{kind}"
    query(_BOOKS)(run)


for _kind in ("csv", "tsv", "dif", "sylk", "xlsx", "ods"):
    _source(_kind)


@query("SELECT c_nationkey::INT AS nation, count(*) AS n, min(c_name) AS first, '| c_custkey | c_name | c_acctbal |' AS head FROM customer GROUP BY 1")
def source_docx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a table each, read and shown as markdown."""
    elements = readers.read_content(_books(spark, sf_dir, "docx"), "docx")
    lines = doc.document_markdown(elements).select("path", F.split("markdown", "\n").alias("l"))
    names = F.array_min(F.transform(F.slice("l", F.lit(3), F.size("l")), lambda s: F.trim(F.split(s, r"\|")[2])))
    return lines.select(F.split("path", r"\.")[0].cast("int").alias("nation"), (F.size("l") - 2).cast("long").alias("n"), names.alias("first"), F.element_at("l", 1).alias("head"))


@query("SELECT c_nationkey::INT AS nation, string_agg(line, chr(10) ORDER BY c_custkey) AS text FROM (SELECT c_nationkey, -1 AS c_custkey, 'c_custkey;c_name' AS line FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, c_custkey, c_custkey || ';' || c_name FROM customer) GROUP BY 1")
def source_workbook_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = writers.workbooks(read(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], ["c_custkey", "c_name"], "xlsx")
    text = doc.cells_text(readers.read_content(books, "xlsx"), ";")
    return text.select(F.split("path", r"\.")[0].cast("int").alias("nation"), "text")


@query("SELECT r_name AS name, r_regionkey::INT AS key, 'Region ' || r_name AS title, 'xlsx' AS format FROM region")
def source_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udf("binary")
    def book(name: str, key: int) -> bytes:
        return writers.xlsx_bytes({name: [[name, key, True, None, 1.5]]}, f"Region {name}")

    files = read(spark, sf_dir, "region").select(F.col("r_name").alias("path"), book("r_name", "r_regionkey").alias("content"))
    cells = readers.read_content(files, "xlsx").where("col = 2").select("path", F.col("value").cast("int").alias("key"))
    titles = readers.read_content(files, "properties").where("name = 'title'").select("path", F.col("value").alias("title"))
    formats = readers.parsed(files, lambda b: iter([{"format": readers.office.detect(b)}]), "path string, format string")
    return cells.join(titles, "path").join(formats, "path").select(F.col("path").alias("name"), "key", "title", "format")


@query(
    "SELECT c_nationkey::INT AS nation, round(sum(c_acctbal), 4) + 0.0 AS total, round(avg(CASE WHEN i <= 3 THEN c_acctbal END), 4) + 0.0 AS mean3, round(max(c_acctbal) - min(c_acctbal), 4) + 0.0 AS spread, count(*)::DOUBLE AS n, (count(*) + 1)::DOUBLE AS names, "
    "round(max(CASE WHEN i = 1 THEN c_custkey END) * 2.0::DOUBLE, 4) + 0.0 AS first2, CASE WHEN sum(c_acctbal) > 100000 THEN 'rich' ELSE 'poor' END AS verdict, count(*) FILTER (WHERE c_acctbal > 5000)::DOUBLE AS big, 1.0::DOUBLE AS head, '#VALUE!' AS bad_err FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) GROUP BY 1"
)
def grid_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of every workbook's cells: ranges, a defined name, single cells, and formulas that use each other."""
    f = {
        "total": "=SUM(Sheet1!$C$2:$C$100000)", "mean3": "=AVERAGE(C2:C4)", "spread": "=MAX(balances)-MIN(balances)", "n": "=COUNT(A1:A100000)", "names": "=COUNTA(B1:B100000)", "first2": "=A2*2", "verdict": '=IF(total>100000,"rich","poor")',
        "big": '=COUNTIF(C2:C100000,">5000")', "head": '=COUNTIF(A1:C1,"c_name")', "bad": "=B1+1",
    }
    cells = readers.read_content(_books(spark, sf_dir, "xlsx"), "xlsx")
    out = grid.evaluate(cells, f, {"balances": "Sheet1!C2:C100000"}).withColumn("nation", F.split("path", r"\.")[0].cast("int"))
    return rounded(out.select("nation", "total", "mean3", "spread", "n", "names", "first2", "verdict", "big", "head", "bad_err"), ["total", "mean3", "spread", "first2"], 4)
