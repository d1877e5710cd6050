"""Table operators: lookups, database functions, pivots, totals rows, ranking, filters, validation, labels, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.aggregates import AGGREGATES
from tabulon.functions.criteria import matches, rectangle
from tabulon.functions.values import TEXT, V, is_blank, number, of_column
from tabulon.operators.lineage import ensure_checkpoint_dir


def _value(df: DataFrame, column: str):
    return of_column(F.col(f"`{column}`"), df.schema[column].dataType)


# Lookups


def first_match(table: DataFrame, key: str, position: list[str]) -> DataFrame:
    """The first row of each key in the order of ``position``: an aggregate, so a hot key is combined before
    the shuffle and no key's rows are sorted together."""
    rest = [c for c in table.columns if c != key]
    picked = table.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*position)).alias("__row"))
    return picked.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def lookup(df: DataFrame, value: str, table: DataFrame, key: str, returns: dict[str, str], position: list[str], missing: dict[str, object] | None = None) -> DataFrame:
    """XLOOKUP and VLOOKUP, exact: adds the returned columns (new name: column of ``table``) of the first row
    whose key equals ``value``; where none does, ``missing``'s value, else null.  Catalyst picks the join."""
    found = first_match(table.select(*dict.fromkeys([key, *returns.values(), *position])), key, position)
    right = found.select(F.col(f"`{key}`").alias("__key"), F.lit(True).alias("__hit"), *[F.col(f"`{c}`").alias(n) for n, c in returns.items()])
    out = df.join(right, df[value] == F.col("__key"), "left")
    for n, v in (missing or {}).items():
        out = out.withColumn(n, F.when(F.col("__hit"), F.col(n)).otherwise(F.lit(v)))
    return out.drop("__key", "__hit")


def match(df: DataFrame, value: str, table: DataFrame, key: str, position: str, out: str = "match") -> DataFrame:
    """MATCH and XMATCH, exact: the smallest position of an equal key, else null."""
    first = table.groupBy(F.col(key).alias("__key")).agg(F.min(position).alias(out))
    return df.join(first, df[value] == F.col("__key"), "left").drop("__key")


def transposed(row_wide: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """For HLOOKUP: columns become rows (name, label, value)."""
    return row_wide.unpivot([label], columns, "name", "value")


def has_match(df: DataFrame, value: str, table: DataFrame, key: str) -> DataFrame:
    """COUNTIF(range, key) > 0 as a semi join."""
    return df.join(table.select(F.col(key).alias("__key")), df[value] == F.col("__key"), "left_semi")


def lacks_match(df: DataFrame, value: str, table: DataFrame, key: str) -> DataFrame:
    return df.join(table.select(F.col(key).alias("__key")), df[value] == F.col("__key"), "left_anti")


# Database functions


def database(df: DataFrame, criteria: list[dict[str, object]], fields: dict[str, tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """D functions over the rows that meet the criteria rectangle, all in one pass: ``fields`` maps a result to
    (function, field).  No row that meets it is an error (null), but for DCOUNT and DCOUNTA."""
    met = df.where(_meets(df, criteria))
    return met.groupBy(*(by or [])).agg(*[_database(df, function, field, F.lit(True)).alias(out) for out, (function, field) in fields.items()])


_PLAIN = {"DSUM": "SUM", "DAVERAGE": "AVERAGE", "DPRODUCT": "PRODUCT", "DSTDEV": "STDEV.S", "DSTDEVP": "STDEV.P", "DVAR": "VAR.S", "DVARP": "VAR.P", "DMAX": "MAX", "DMIN": "MIN", "DCOUNT": "COUNT"}


def _meets(df: DataFrame, criteria: list[dict[str, object]]) -> Column:
    return rectangle({c: _value(df, c) for row in criteria for c in row}, criteria)


def _database(df: DataFrame, function: str, field: str, hit: Column) -> Column:
    v = _value(df, field)
    v = V(F.when(hit, v.col), v.kind, v.err)
    n = F.count_if(hit)
    if function == "DCOUNTA":
        return F.count_if(hit & ~is_blank(v)).cast("double")
    if function == "DGET":
        return F.when(n == 1, F.max(v.col))
    c = AGGREGATES[_PLAIN[function]](v).value()
    return c if function == "DCOUNT" else F.when(n > 0, c)


def database_column(df: DataFrame, criteria: list[dict[str, object]], function: str, field: str) -> Column:
    """A D function as an aggregate over all rows, which counts those that meet the criteria."""
    return _database(df, function, field, F.coalesce(_meets(df, criteria), F.lit(False)))


# Pivots and totals

SUMMARIES = {
    "sum": F.sum, "average": F.avg, "count": F.count, "countNums": F.count, "max": F.max, "min": F.min, "product": F.product,
    "stdDev": F.stddev_samp, "stdDevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}


def pivot(df: DataFrame, rows: list[str], column: str, values: list, measure: str, function: str = "sum", page: Column | None = None) -> DataFrame:
    """A pivot table: the page field filters, row fields group, the column field's values spread."""
    source = df if page is None else df.where(page)
    return source.groupBy(*rows).pivot(column, values).agg(SUMMARIES[function](measure))


def subtotals(df: DataFrame, rows: list[str], measures: dict[str, tuple[str, str]], cube: bool = False) -> DataFrame:
    """Grouped measures with subtotals and the grand total; ``level`` is the number of fields summed over."""
    grouped = df.cube(*rows) if cube else df.rollup(*rows)
    level = reduce(lambda a, b: a + b, [F.grouping(r).cast("int") for r in rows])
    return grouped.agg(level.alias("level"), *[SUMMARIES[f](c).alias(n) for n, (f, c) in measures.items()])


def show_as_share(df: DataFrame, measure: str, by: list[str], out: str = "share") -> DataFrame:
    """showDataAs percent of the total of ``by``."""
    total = df.groupBy(*by).agg(F.sum(measure).alias("__total"))
    joined = df.join(total, by) if by else df.crossJoin(F.broadcast(total))
    return joined.withColumn(out, F.try_divide(F.col(measure), F.col("__total"))).drop("__total")


def with_totals_row(df: DataFrame, totals: dict[str, str], label: str) -> DataFrame:
    """The table with a totals row below: its first column the label, others by function name."""
    first = df.columns[0]
    row = df.agg(*[SUMMARIES[f](c).cast(df.schema[c].dataType).alias(c) for c, f in totals.items()]).withColumn(first, F.lit(label).cast(df.schema[first].dataType))
    return df.withColumn("is_total", F.lit(False)).unionByName(row.withColumn("is_total", F.lit(True)), allowMissingColumns=True)


# Ranking


#: Ranges of values, at most, in which a group's values are put in order apart.
RANGES = 256


def _range_of(value: str, bounds: list) -> Column:
    """The number of bounds below the value, by halving."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    below, above = _range_of(value, bounds[:mid]), _range_of(value, bounds[mid + 1 :])
    return F.when(F.col(value) <= F.lit(bounds[mid]), below).otherwise(above + (mid + 1))


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, __peers, __below, __n): the different numbers of each group, how many rows have each, have a
    smaller one, and have any.

    Values are dealt into ranges by quantiles over all of them, and only the rows of a range and group are put in order
    together; sums of the ranges, a row each, say how many lie below.  So no group is sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__peers"))
    width = min(RANGES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = df.agg(F.percentile_approx(value, [i / width for i in range(1, width)], 10 * width)).first()[0] if width > 1 else None
    counts = counts.withColumn("__range", _range_of(value, sorted(set(cuts or []))).cast("int"))
    sizes = counts.groupBy(*by, "__range").agg(F.sum("__peers").alias("__rows"))
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = F.sum("__rows").over(groups.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*by, "__range", F.coalesce(below, F.lit(0)).alias("__offset"), F.sum("__rows").over(groups).alias("__n"))
    within = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__in", F.coalesce(F.sum("__peers").over(within), F.lit(0)))
    joined = placed.join(offsets.select(*[F.col(k).alias(f"__by{i}") for i, k in enumerate(by)], F.col("__range").alias("__r"), "__offset", "__n"), [F.col("__range") == F.col("__r"), *[F.col(k).eqNullSafe(F.col(f"__by{i}")) for i, k in enumerate(by)]])
    return joined.select(*by, value, "__peers", (F.col("__in") + F.col("__offset")).alias("__below"), "__n")


def value_ranks(df: DataFrame, value: str, ascending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, rank_eq, rank_avg) of the different values."""
    counts = value_counts(df, value, list(by))
    first = F.col("__below") + 1 if ascending else F.col("__n") - F.col("__below") - F.col("__peers") + 1
    return counts.select(*by, value, first.alias("rank_eq"), (first + (F.col("__peers") - 1) / 2).alias("rank_avg"))


def value_percents(df: DataFrame, value: str, digits: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, rank_inc, rank_exc) of the different values, cut to digits."""
    cut = lambda c: F.floor(c * 10**digits + 1e-9) / 10**digits
    counts = value_counts(df, value, list(by))
    return counts.select(*by, value, cut(F.try_divide(F.col("__below"), F.col("__n") - 1)).alias("rank_inc"), cut((F.col("__below") + 1) / (F.col("__n") + 1)).alias("rank_exc"))


def order_statistics(df: DataFrame, value: str, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, each wanted) of groups of any size, from the counts of their different values: ``wanted`` maps a column to
    (kind, k), a kind being ``inc`` and ``exc`` for the percentile k, ``small`` and ``large`` for the k-th number, and
    ``trim`` for the mean without the share k at the ends.  Null where the group has no such number."""
    counts = value_counts(df, value, by)
    n, below, peers, v = F.col("__n"), F.col("__below"), F.col("__peers"), F.col(value)
    columns: list[Column] = []
    for out, (kind, k) in wanted.items():
        if kind == "trim":
            cut = F.floor(F.floor(n * k) / 2)
            inside = F.greatest(F.lit(0), F.least(below + peers, n - cut) - F.greatest(below, cut))
            columns.append(F.try_divide(F.sum(v * inside), F.sum(inside)).alias(out))
            continue
        at = {"inc": (n - 1) * F.lit(float(k)), "exc": (n + 1) * F.lit(float(k)) - 1, "small": F.lit(float(k - 1)), "large": (n - F.lit(k)).cast("double")}[kind]
        low = F.floor(at)
        here = lambda i: (below <= i) & (i < below + peers)
        lo, hi, part = F.max(F.when(here(low), v)), F.max(F.when(here(low + 1), v)), F.max(at - low)
        columns.append(F.when(part == 0, lo).otherwise(lo + (hi - lo) * part).alias(out))
    return counts.groupBy(*by).agg(*columns)


def rank(df: DataFrame, value: str, by: list[str], ascending: bool = False) -> DataFrame:
    """RANK.EQ and RANK.AVG within groups; what is ranked is one row a value, and joins back."""
    return df.join(value_ranks(df, value, ascending, tuple(by)), [*by, value], "left")


def percent_rank(df: DataFrame, value: str, by: list[str], digits: int = 3) -> DataFrame:
    """PERCENTRANK.INC and .EXC within groups, cut to digits."""
    return df.join(value_percents(df, value, digits, tuple(by)), [*by, value], "left")


def top(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The k first rows: a partial top k in each task."""
    return df.orderBy(*order).limit(k)


def numbered(df: DataFrame, order: list[Column], ranges: Column, out: str) -> DataFrame:
    """Adds the rows' numbers, from 1, in ``order``.  ``ranges`` is a key that rises with the order: rows of a range
    are put in order apart, and the ranges' sizes say where each begins."""
    ranged = df.withColumn("__range", ranges)
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__offset"))
    placed = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    joined = placed.join(offsets, F.col("__range").eqNullSafe(F.col("__r")))
    return joined.withColumn(out, F.col("__in") + F.col("__offset")).drop("__range", "__r", "__in", "__offset")


# Filters, sorting, validation, labels


def auto_filter(df: DataFrame, conditions: dict[str, tuple[str, ...]], any_of: dict[str, bool] | None = None) -> DataFrame:
    """Auto-filter: for each column one or two criteria, joined by and (or by or where ``any_of`` says so)."""
    for c, specs in conditions.items():
        tests = [matches(_value(df, c), s) for s in specs]
        df = df.where(reduce((lambda a, b: a | b) if (any_of or {}).get(c) else (lambda a, b: a & b), tests))
    return df


def sort_key(df: DataFrame, column: str, descending: bool = False, custom: list[str] | None = None, case_sensitive: bool = False) -> Column:
    """A sort state's key: by value, or by place in a custom list (others after it); text folds case unless told not to."""
    c = F.col(f"`{column}`")
    if custom:
        at = F.array_position(F.array(*map(F.lit, custom)), c)
        c = F.when(at > 0, at).otherwise(F.lit(len(custom) + 1))
    elif not case_sensitive and _value(df, column).kind == TEXT:
        c = F.lower(c)
    return c.desc() if descending else c.asc()


def violations(df: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    """Rows that break a data validation, with ``rule``: (column, operator, bounds...)."""
    tests = []
    for name, (column, op, *bounds) in rules.items():
        v = number(_value(df, column)) if op != "list" else F.col(column)
        ok = {
            "between": lambda: v.between(*bounds), "notBetween": lambda: ~v.between(*bounds), "equal": lambda: v == bounds[0], "notEqual": lambda: v != bounds[0], "greaterThan": lambda: v > bounds[0],
            "lessThan": lambda: v < bounds[0], "greaterThanOrEqual": lambda: v >= bounds[0], "lessThanOrEqual": lambda: v <= bounds[0], "list": lambda: v.isin(list(bounds[0])), "textLength": lambda: F.length(F.col(column)).between(*bounds),
        }[op]()
        tests.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    return df.withColumn("rule", F.explode(F.array_compact(F.array(*tests))))


def color_scale(df: DataFrame, value: str, out: str = "scale") -> DataFrame:
    """Conditional format by colour scale: 0 at the least value, 1 at the greatest."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")


def icon_set(value: Column, cuts: list[float], icons: list[str]) -> Column:
    out = F.lit(icons[0])
    for c, i in zip(cuts, icons[1:], strict=True):
        out = F.when(value >= c, i).otherwise(out)
    return out


def find_text(df: DataFrame, column: str, needle: str, ignore_case: bool = False) -> DataFrame:
    c = F.col(column)
    return df.where(F.lower(c).contains(needle.lower()) if ignore_case else c.contains(needle))


# Ranges of cells


def cells(df: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Long form (row, col, value as text) of a table; columns are numbered from 1."""
    parts = F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns, 1)])
    return df.select(F.col(position).alias("row"), F.explode(parts).alias("c")).select("row", "c.col", "c.value")


def cell_range(grid: DataFrame, start_row: int, start_col: int, end_row: int, end_col: int) -> DataFrame:
    """A rectangle of cells; its corners may come in any order."""
    r, c = sorted((start_row, end_row)), sorted((start_col, end_col))
    return grid.where(F.col("row").between(*r) & F.col("col").between(*c))


def index(grid: DataFrame, row: int, col: int) -> DataFrame:
    return grid.where((F.col("row") == row) & (F.col("col") == col))


def used_range(grid: DataFrame) -> DataFrame:
    full = F.coalesce(F.col("value"), F.lit("")) != ""
    return grid.where(full).agg(F.min("row").alias("first_row"), F.min("col").alias("first_col"), F.max("row").alias("last_row"), F.max("col").alias("last_col"))


def vstack(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def wrap_rows(df: DataFrame, position: str, value: str, width: int) -> DataFrame:
    """A vector (positions from 0) as rows of ``width`` columns c1, c2, ..."""
    row, col = F.floor(F.col(position) / width).cast("long"), (F.pmod(F.col(position), F.lit(width)) + 1).cast("int")
    return df.select(row.alias("row"), col.alias("col"), F.col(value).alias("value")).groupBy("row").agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"c{i}") for i in range(1, width + 1)])


# Graphs


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reachable(edges: DataFrame, sources: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(node, steps): what can be reached from the sources, within ``max_steps`` if given, breadth first; each
    round joins only the last round's nodes with the edges, and lineage is cut."""
    ensure_checkpoint_dir(edges.sparkSession)
    seen = sources.select(F.col("node"), F.lit(0).alias("steps")).distinct()
    front, step = seen, 0
    while max_steps is None or step < max_steps:
        step += 1
        new = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(step))
        front = new.checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if step % 16 == 0:
            seen = seen.checkpoint()
    return seen
