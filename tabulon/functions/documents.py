"""Document text: statistics, markdown export, format detection from the first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_LINE, LINES_PER_PAGE = 80, 46


def statistics(text: Column) -> dict[str, Column]:
    """Words, characters with and without white space, paragraphs, and estimates of lines and pages."""
    t = F.coalesce(text, F.lit(""))
    words = F.when(F.trim(F.regexp_replace(t, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")))
    paragraphs = F.size(F.filter(F.split(t, "\n"), lambda p: F.trim(p) != ""))
    lines = F.ceil(F.length(t) / CHARS_PER_LINE)
    return {"words": words, "characters": F.length(t), "characters_no_spaces": F.length(F.regexp_replace(t, r"\s", "")), "paragraphs": paragraphs, "lines": lines, "pages": F.greatest(F.ceil(lines / LINES_PER_PAGE), F.lit(1))}


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def run_markdown(text: Column, bold: Column, italic: Column, strike: Column) -> Column:
    """A run with its marks, innermost strike."""
    marked = F.when(strike, F.concat(F.lit("~~"), text, F.lit("~~"))).otherwise(text)
    return F.when(bold & italic, F.concat(F.lit("***"), marked, F.lit("***"))).when(bold, F.concat(F.lit("**"), marked, F.lit("**"))).when(italic, F.concat(F.lit("*"), marked, F.lit("*"))).otherwise(marked)


def table_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markdown) of tables given by their cells (row, col, text): a header row, a rule, further rows."""
    clean = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", clean.alias("t")))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda c: c["t"]), " | "), F.lit(" |"))
    lined = rows.select(*keys, "row", line.alias("line"), F.size("c").alias("n"))
    gathered = lined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "line", "n"))).alias("r"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.element_at("r", 1)["n"]))
    text = F.transform("r", lambda r: r["line"])
    return gathered.select(*keys, F.array_join(F.concat(F.slice(text, 1, 1), F.array(rule), F.slice(text, F.lit(2), F.size(text))), "\n").alias("markdown"))


def document_markdown(elements: DataFrame) -> DataFrame:
    """(path, markdown) of documents given by their elements, as the DOCX reader has them: headings by their style's
    number, list items by theirs, runs with their marks, tables with their first row as head."""
    level = F.regexp_extract("style", r"(?i)^heading ?([1-9])", 1)
    runs = F.array_join(F.transform("runs", lambda r: run_markdown(markdown_escape(r["text"]), r["bold"], r["italic"], r["strike"])), "")
    lead = F.when(level != "", F.concat(F.repeat(F.lit("#"), F.least(level.try_cast("int"), F.lit(6))), F.lit(" "))).when(F.lower("style") == "title", "# ").when(F.lower("style").startswith("list"), "- ").otherwise("")
    clean = lambda s: F.replace(F.replace(F.coalesce(s, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    blank, rule = F.lit("|  |\n"), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.filter("cells", lambda c: c["row"] == 0))))

    def piece(c: Column, i: Column, before: Column) -> Column:
        """A cell's text and what parts it from the cell before: rows without cells are lines too, the rule follows row 0."""
        gap = F.when(before == -1, F.when(c["row"] > 0, F.concat(blank, rule, F.lit("\n"), F.repeat(blank, c["row"] - 1))).otherwise("")).otherwise(F.concat(F.when(before == 0, F.concat(rule, F.lit("\n"))).otherwise(""), F.repeat(blank, c["row"] - before - 1)))
        return F.concat(F.when(c["row"] == before, " | ").otherwise(F.concat(F.when(i > 0, " |\n").otherwise(""), gap, F.lit("| "))), clean(c["text"]))

    # one pass over the cells in order of rows; each looks at the one before it
    placed = F.array_sort(F.transform("cells", lambda c, i: F.struct(c["row"].alias("row"), i.alias("i"), c["text"].alias("text"))))
    text = lambda cells: F.concat(F.array_join(F.transform(cells, lambda c, i: piece(c, i, F.coalesce(F.get(cells, i - 1)["row"], F.lit(-1)))), ""), F.lit(" |"), F.when(F.element_at(cells, -1)["row"] == 0, F.concat(F.lit("\n"), rule)).otherwise(""))
    table = F.transform(F.array(placed), text)[0]
    part = F.when(F.col("kind") == "table", F.when(F.size("cells") > 0, table)).otherwise(F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.coalesce(lead, F.lit("")), runs)))
    gathered = elements.where("elem is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("elem", part.alias("p")))).alias("e"))
    return gathered.select("path", F.array_join(F.filter(F.transform("e", lambda x: x["p"]), lambda p: p.isNotNull()), "\n\n").alias("markdown"))


def cells_text(cells: DataFrame, separator: str = "\t") -> DataFrame:
    """(path, sheet, text) of sheets given by their cells: rows in order, cells by column, empty ones included."""
    rows = cells.where("row is not null").groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit(""))))).alias("v"), F.max("col").alias("n"))
    line = F.array_join(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.coalesce(F.try_element_at("v", i), F.lit(""))), separator)
    gathered = rows.groupBy("path", "sheet").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("r"))
    return gathered.select("path", "sheet", F.array_join(F.transform("r", lambda r: r["line"]), "\n").alias("text"))


def conversation_markdown(turns: DataFrame) -> DataFrame:
    """(conv_id, markdown): each turn under a heading of its role, turns parted by a rule."""
    part = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("t"))
    return gathered.select("conv_id", F.array_join(F.transform("t", lambda x: x["p"]), "\n\n---\n\n").alias("markdown"))


def detect_format(content: Column) -> Column:
    """Format by the first bytes: ole2, zip, rtf, pdf, html, xml or text (containers are told apart by their
    members, see ``tabulon.sources.office``)."""
    head = F.substring(content, 1, 8)
    text = F.lower(F.ltrim(F.substring(content, 1, 64).cast("string")))
    return (
        F.when(head == F.lit(bytearray.fromhex("D0CF11E0A1B11AE1")), "ole2").when(F.substring(content, 1, 4) == F.lit(bytearray(b"PK\x03\x04")), "zip")
        .when(F.substring(content, 1, 5) == F.lit(bytearray(b"{\\rtf")), "rtf").when(F.substring(content, 1, 5) == F.lit(bytearray(b"%PDF-")), "pdf")
        .when(text.startswith("<!doctype html") | text.startswith("<html"), "html").when(text.startswith("<?xml"), "xml").otherwise("text")
    )
