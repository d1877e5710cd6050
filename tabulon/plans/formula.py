"""Formula strings compiled to Column expressions over a header-ed DataFrame.

Grammar, loosest first: comparison (= <> > >= < <=), + -, * /, unary minus, primary.  A primary is a number, a
text in double quotes, TRUE or FALSE, a call, a name, or a structured reference: ``[@column]``, ``[column]``,
``Table[column]``, ``Table[[first]:[last]]``, ``Table[#All]``, ``Table[#Data]``, ``Table[@column]``,
``Table[[#This Row],[column]]``, ``Table[[#Headers],[column]]``.  The formula is parsed once on the driver; rows meet
only the resulting expression, which Catalyst plans like any other.  References to other tables become joins, ranks
become counts of different values that join back.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import bonds_units  # noqa: F401  registers its functions
from tabulon.functions.aggregates import AGGREGATES, ORDERED
from tabulon.functions.scalar import SCALARS
from tabulon.functions.values import BOOL, DIV_ERROR, NA, NUM, NUM_ERROR, VALUE_ERROR, V, error, first_error, lit, number, number_arg, of_column, text
from tabulon.operators import tables as op

_INNER = r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]"
_TOKEN = re.compile(rf'\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|"((?:[^"]|"")*)"|([A-Za-z_][\w.]*(?:{_INNER})?|{_INNER})|(<=|>=|<>|[-+*/=<>(),]))')


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()


class FormulaError(ValueError):
    pass


@dataclass
class Table:
    """A table that formulas look things up in.  ``position`` is the column with its rows' numbers, from 1, which says
    what comes first."""

    df: DataFrame
    position: str

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.position]


@dataclass
class Range:
    """Columns of a table, of the formulas' own one where it has no name."""

    name: str | None
    columns: list[str]
    headers: bool = False
    literal: object = None
    aggregate: bool = False
    depth: int = 0


@dataclass
class _Step:
    """What a formula needs before it: columns, each with the depth at which it can be made, and joins between."""

    columns: list[tuple[str, Column]] = field(default_factory=list)
    joins: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


def tokenize(source: str) -> list[tuple[str, str]]:
    s, at, out = source.strip().removeprefix("="), 0, []
    s = s.rstrip()
    while at < len(s):
        m = _TOKEN.match(s, at)
        if not m:
            raise FormulaError(f"unexpected {s[at:]!r}")
        kind = ("number", "string", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex].replace('""', '"') if kind == "string" else m[m.lastindex]))
        at = m.end()
    return out


def parse(source: str) -> Node:
    tokens, at = tokenize(source), 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def take(sign: str | None = None) -> tuple[str, str]:
        nonlocal at
        t = peek()
        if sign is not None and t != ("sign", sign):
            raise FormulaError(f"{sign} expected, not {t[1]!r}")
        at += 1
        return t

    def left(signs: tuple[str, ...], below):
        def run() -> Node:
            node = below()
            while peek()[0] == "sign" and peek()[1] in signs:
                op = take()[1]
                node = Node(op, (node, below()))
            return node

        return run

    def unary() -> Node:
        if peek() == ("sign", "-"):
            take()
            return Node("neg", (unary(),))
        return primary()

    def primary() -> Node:
        kind, s = take()
        if kind == "number":
            return Node("lit", (float(s),))
        if kind == "string":
            return Node("lit", (s,))
        if (kind, s) == ("sign", "("):
            node = expression()
            take(")")
            return node
        if kind != "name":
            raise FormulaError(f"unexpected {s!r}")
        if peek() == ("sign", "("):
            take()
            args = []
            while peek() != ("sign", ")"):
                args.append(Node("lit", (None,)) if peek() == ("sign", ",") else expression())
                if peek() == ("sign", ","):
                    take()
            take(")")
            return Node("call", (s.upper(), *args))
        if s.upper() in ("TRUE", "FALSE"):
            return Node("lit", (s.upper() == "TRUE",))
        return Node("ref", (s,))

    products = left(("*", "/"), unary)
    sums = left(("+", "-"), products)
    expression = left(("=", "<>", ">", ">=", "<", "<="), sums)
    node = expression()
    if peek()[0] != "end":
        raise FormulaError(f"unexpected {peek()[1]!r}")
    return node


def _arithmetic(op: str, a: V, b: V) -> V:
    x, y = number_arg(a), number_arg(b)
    out = {"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col, "/": F.try_divide(x.col, y.col)}[op]
    errs = [v.err for v in (x, y) if not isinstance(v.literal, float)]
    if op == "/":
        errs.append(F.when(y.col == 0, F.lit(DIV_ERROR)))
    return V(out, NUM, first_error(*errs), aggregate=a.aggregate or b.aggregate, strict=True)


def _compare(op: str, a: V, b: V) -> V:
    """Numbers as numbers; anything else as text, case-sensitively, an empty cell being ''."""
    if a.kind in (NUM, "date") and b.kind in (NUM, "date"):
        x, y = number_arg(a), number_arg(b)
        p, q = x.col, y.col
    else:
        p, q = text(V(a.col, a.kind)), text(V(b.col, b.kind))
    out = {"=": p == q, "<>": p != q, ">": p > q, ">=": p >= q, "<": p < q, "<=": p <= q}[op]
    return V(F.coalesce(out, F.lit(op == "<>")), BOOL, first_error(a.err, b.err), aggregate=a.aggregate or b.aggregate)


def accepts(f: Callable, n: int) -> bool:
    """Whether a function takes n arguments."""
    if hasattr(f, "arity"):
        return f.arity[0] <= n <= f.arity[1]
    try:
        inspect.signature(f).bind(*[None] * n)
    except TypeError:
        return False
    except ValueError:  # a built-in without a signature
        return True
    return True


class Compiler:
    """Compiles formulas against a DataFrame's columns and further names (values, formulas, criteria), and tables.

    ``position`` is the column that numbers the rows, for ROW; ``order`` the one that cash flows follow.
    """

    def __init__(self, df: DataFrame, names: dict[str, object] | None = None, tables: dict[str, Table] | None = None, position: str | None = None, order: str | None = None):
        self.df = df
        self.fields = {f.name.upper(): f for f in df.schema.fields}
        self.names = {k.upper(): v for k, v in (names or {}).items()}
        self.tables = {k.upper(): t for k, t in (tables or {}).items()}
        self.position, self.order = position, order
        self.steps: dict[int, _Step] = {}
        self.made = 0
        self.groups: list[str] | None = None
        self.statistics: dict[str, tuple[V, dict[str, tuple[str, float]]]] = {}

    def compile(self, source: str) -> V:
        out = self._value(parse(source))
        if isinstance(out, Range):
            raise FormulaError("a range is no value")
        return out

    def _value(self, n: Node) -> V | Range:
        if n.op == "lit":
            return lit(n.args[0])
        if n.op == "ref":
            return self._ref(n.args[0])
        if n.op == "neg":
            x = self._value(n.args[0])
            if isinstance(x.literal, float):
                return lit(-x.literal)
            y = number_arg(self._plain(x))
            return V(-y.col, NUM, y.err, aggregate=x.aggregate, strict=True, depth=x.depth)
        if n.op == "call":
            return self._call(n.args[0], [self._value(a) for a in n.args[1:]], n.args[1:])
        a, b = (self._plain(self._value(x)) for x in n.args)
        out = _arithmetic(n.op, a, b) if n.op in "+-*/" else _compare(n.op, a, b)
        out.depth = max(a.depth, b.depth)
        return out

    def _plain(self, x: V | Range) -> V:
        """A range of one column of the formulas' own table is that column; any other is no value."""
        if isinstance(x, Range):
            if x.name is None and len(x.columns) == 1:
                return self._column(x.columns[0])
            raise FormulaError(f"a range of {x.name} is no value")
        return x

    def _column(self, name: str) -> V:
        f = self.fields.get(name.strip().upper())
        if f is None:
            raise FormulaError(f"unknown name {name}")
        return of_column(F.col(f"`{f.name}`"), f.dataType)

    def _ref(self, name: str) -> V | Range:
        table, _, inner = name.partition("[")
        inner = inner.removesuffix("]").strip()
        if table and not inner:
            key = table.upper()
            if key in self.tables and key not in self.fields:
                return Range(key, self.tables[key].columns)
            if key in self.names:
                v = self.names[key]
                return self.compile(v) if isinstance(v, str) and v.startswith("=") else V(F.lit(None), "criteria", literal=v) if isinstance(v, (list, dict)) else lit(v)
            return self._column(table)
        known = self.tables.get(table.upper())
        own = known is None
        columns = list(self.df.columns) if own else known.columns
        named = table.upper() if not own else None
        parts = [p.strip() for p in re.findall(r"\[([^\[\]]*)\]", inner)] or [inner]
        marks, plain = [p.upper() for p in parts if p.startswith("#")], [p.removeprefix("@").strip() for p in parts if not p.startswith("#")]
        if inner.startswith("@"):
            marks.append("#THIS ROW")
        at = [next((i for i, c in enumerate(columns) if c.upper() == p.upper()), None) for p in plain]
        if None in at:
            key = plain[at.index(None)].upper()
            if key in self.names and len(plain) == 1:
                return self._ref(key)
            raise FormulaError(f"unknown name {name}")
        if "#HEADERS" in marks:
            return lit(columns[at[0]]) if len(at) == 1 else Range(named, columns, headers=True)
        if "#TOTALS" in marks:
            raise FormulaError(f"{name}: a table has no totals row but with_totals_row's")
        if "#THIS ROW" in marks:
            if not own:
                raise FormulaError(f"{name}: another table has no this row")
            return self._column(columns[at[0]])
        chosen = columns if not at else columns[min(at) : max(at) + 1] if re.search(r"\]\s*:\s*\[", inner) else [columns[i] for i in at]
        if own and len(chosen) == 1:
            return self._column(chosen[0])
        return Range(named, chosen)

    def _name(self) -> str:
        self.made += 1
        return f"__step{self.made}"

    def _column_step(self, v: V) -> V:
        """The value as a column of its own."""
        at, step = self._name(), self.steps.setdefault(v.depth, _Step())
        step.columns.append((at, v.col))
        err = None
        if v.err is not None:
            step.columns.append((f"{at}_err", v.err))
            err = F.col(f"{at}_err")
        return V(F.col(at), v.kind, err, strict=v.strict, depth=v.depth + 1)

    def _named(self, v: V | Range, n: Node) -> V | Range:
        """A call within a call becomes a column of its own first: functions use their arguments more than
        once, so nested expressions would multiply."""
        if n.op != "call" or isinstance(v, Range) or v.aggregate or v.literal is not None:
            return v
        return self._column_step(v)

    def _call(self, name: str, args: list[V | Range], nodes: tuple) -> V:
        depth = max([a.depth for a in args], default=0)
        if self.groups is not None and name in ORDER_STATISTICS and accepts(AGGREGATES[name], len(args)):
            return self._statistic(name, [self._plain(a) for a in args])
        if name == "COLUMN":
            return self._column_number(nodes)
        if name in TABLE_CALLS:
            if not accepts(TABLE_CALLS[name], len(args) + 1):
                return error(f"{name}: wrong number of arguments")
            out = TABLE_CALLS[name](self, *args)
            out.depth = max(out.depth, depth)
            return out
        args = [self._plain(a) for a in args]
        if name in AGGREGATES and not (name in SCALARS and any(a.aggregate for a in args)):
            f = AGGREGATES[name]
            if name in ORDERED:
                if self.order is None:
                    raise FormulaError(f"{name} needs an order")
                out = f(F.col(self.order), *args) if accepts(f, len(args) + 1) else error(f"{name}: wrong number of arguments")
            else:
                out = f(*args) if accepts(f, len(args)) else error(f"{name}: wrong number of arguments")
            out.aggregate, out.depth = True, depth
            return out
        if name not in SCALARS:
            raise FormulaError(f"Unsupported function: {name}")
        if not accepts(SCALARS[name], len(args)):
            return error(f"{name}: wrong number of arguments")
        args = [self._named(a, n) for a, n in zip(args, nodes, strict=True)]
        out = SCALARS[name](*args)
        out.aggregate = any(a.aggregate for a in args)
        out.depth = max([a.depth for a in args], default=0)
        return out

    def _column_number(self, nodes: tuple) -> V:
        """Of a column of the formulas' own table or of another; without a reference there is none, for the formula's
        own column is new."""
        if len(nodes) != 1 or nodes[0].op != "ref":
            return error("COLUMN: no reference")
        r = self._ref(nodes[0].args[0])
        table, _, inner = nodes[0].args[0].partition("[")
        if isinstance(r, Range):
            all_, first = self.df.columns if r.name is None else self.tables[r.name].columns, r.columns[0]
        else:
            all_, first = self.df.columns, (re.findall(r"[^\[\]@:]+", inner) or [table])[-1]
        return lit(float([k.upper() for k in all_].index(first.strip().upper()) + 1))

    def _statistic(self, name: str, args: list[V]) -> V:
        """A statistic of a group's order: a column that is joined to the group's rows before they are aggregated."""
        kind, k = ORDER_STATISTICS[name]([a.literal for a in args[1:]])
        at = self._name()
        x = number(args[0])
        self.statistics.setdefault(str(x._jc.toString()), (V(x, NUM), {}))[1][at] = (kind, k)
        out = F.max(F.col(at))
        return V(out, NUM, F.when(out.isNull(), F.lit(NUM_ERROR)), aggregate=True, strict=True)

    def _join_statistics(self, df: DataFrame) -> DataFrame:
        base = df
        for i, (x, wanted) in enumerate(self.statistics.values()):
            keys = [f"__g{i}_{j}" for j in range(len(self.groups))]
            values = base.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(self.groups, keys, strict=True)], x.col.alias("__v"))
            found = op.order_statistics(values, "__v", keys, wanted)
            if keys:
                same = [F.col(f"`{b}`").eqNullSafe(F.col(k)) for b, k in zip(self.groups, keys, strict=True)]
                df = df.join(found, same, "left").drop(*keys)
            else:
                df = df.crossJoin(F.broadcast(found))  # one row
        return df

    def prepare(self, df: DataFrame) -> DataFrame:
        """The table with all columns that the formulas compiled so far need, depth by depth."""
        for depth in sorted(self.steps):
            step = self.steps[depth]
            if step.columns:
                df = df.withColumns(dict(step.columns))
            for join in step.joins:
                df = join(df)
        return df

    # Looking things up

    def _table(self, r: Range) -> tuple[DataFrame, str]:
        t = self.tables[r.name]
        return t.df, t.position

    def _found(self, key: V, r: Range, at: str, returned: dict[str, Column]) -> dict[str, Column]:
        """Columns of the first row of the range's table whose column ``at`` equals the key (numbers as numbers,
        all else as text, an empty cell as an empty text), by a join; null where there is none."""
        df, position = self._table(r)
        kind = of_column(F.col(f"`{at}`"), df.schema[at].dataType)
        as_number = kind.kind == NUM and key.kind == NUM
        same = number if as_number else text
        mine = self._column_step(V(same(key), key.kind, key.err, strict=True, depth=key.depth))
        names = {k: f"{self._name()}_{i}" for i, k in enumerate(returned)}
        hit = self._name()
        first = df.select(same(kind).alias("__key"), F.col(position).alias("__position"), *[c.alias(names[k]) for k, c in returned.items()])
        first = op.first_match(first.where("__key is not null"), "__key", ["__position"]).drop("__position").withColumn(hit, F.lit(True))

        def join(left: DataFrame) -> DataFrame:
            return left.join(first, F.when(mine.err.isNull(), mine.col).eqNullSafe(F.col("__key")) if mine.err is not None else mine.col == F.col("__key"), "left").drop("__key")

        self.steps.setdefault(mine.depth, _Step()).joins.append(join)
        return {k: F.col(n) for k, n in names.items()} | {"__hit": F.col(hit), "__err": mine.err, "__depth": mine.depth + 1}

    def _result(self, r: Range, column: str, found: dict, missing: V | None = None, lost: str = NA) -> V:
        dtype = self.tables[r.name].df.schema[column].dataType
        v = of_column(found[column], dtype)
        lacking = F.when(found["__hit"].isNull(), F.lit(lost))
        if missing is None:
            return V(v.col, v.kind, first_error(found["__err"], lacking), strict=True, depth=found["__depth"])
        there = found["__hit"].isNotNull()
        if missing.kind == v.kind:
            return V(F.when(there, v.col).otherwise(missing.value()), v.kind, first_error(found["__err"], missing.err), depth=found["__depth"])
        return V(F.when(there, text(v)).otherwise(text(missing)), "text", first_error(found["__err"], missing.err), depth=found["__depth"])


def _exact(mode: V | None, allowed: tuple = (0.0, False)) -> bool:
    return mode is None or mode.literal in allowed


def _vlookup(c: Compiler, x: V, table: Range, number_: V, mode: V | None = None) -> V:
    i = number_.literal
    if not isinstance(i, float) or not 1 <= int(i) <= len(table.columns):
        return error("VLOOKUP: column out of bounds")
    if not _exact(mode):
        return error("VLOOKUP: exact matches only")
    column = table.columns[int(i) - 1]
    found = c._found(c._plain(x), table, table.columns[0], {column: F.col(f"`{column}`")})
    return c._result(table, column, found, lost="VLOOKUP: value not found")


def _hlookup(c: Compiler, x: V, table: Range, number_: V, mode: V | None = None) -> V:
    """Row 1 is the headers: the column of that name, at the row of the given number."""
    i = number_.literal
    if not isinstance(i, float) or int(i) < 1:
        return error("HLOOKUP: row out of bounds")
    if not _exact(mode):
        return error("HLOOKUP: exact matches only")
    df, position = c._table(table)
    if isinstance(x.literal, str):  # the column is known, and with it the kind of the result
        if x.literal not in table.columns:
            return error("HLOOKUP: value not found")
        of = F.col(f"`{x.literal}`")
        return lit(x.literal) if i == 1 else c._result(table, x.literal, c._found(lit(i - 1), table, position, {x.literal: of}), lost="HLOOKUP: row out of bounds")
    kinds = {v.kind for v in (of_column(F.col(f"`{k}`"), df.schema[k].dataType) for k in table.columns)}
    same = kinds == {NUM}
    cells = [F.struct(F.lit(k).alias("k"), (F.lit(k) if i == 1 else F.col(f"`{k}`").cast("double" if same else "string")).alias("v")) for k in table.columns]
    row = df.where(F.col(position) == int(i) - 1) if i > 1 else df.limit(1)
    long = row.select(F.lit(1).alias("__position"), F.explode(F.array(*cells)).alias("c")).select("__position", F.col("c.k").alias("name"), F.col("c.v").alias("value"))
    at = f"__HLOOKUP{c.made}"
    c.tables[at] = Table(long, "__position")
    r = Range(at, ["name", "value"])
    return c._result(r, "value", c._found(c._plain(x), r, "name", {"value": F.col("value")}), lost="HLOOKUP: value not found")


def _xlookup(c: Compiler, x: V, keys: Range, values: Range, missing: V | None = None, mode: V | None = None, search: V | None = None) -> V:
    if not _exact(mode) or not _exact(search, (1.0,)):
        return error("XLOOKUP: exact matches only")
    if len(keys.columns) != 1 or len(values.columns) != 1 or keys.name != values.name:
        return error("XLOOKUP: one column each of one table")
    column = values.columns[0]
    found = c._found(c._plain(x), keys, keys.columns[0], {column: F.col(f"`{column}`")})
    return c._result(values, column, found, missing, "XLOOKUP: value not found")


def _match(c: Compiler, x: V, keys: Range, mode: V | None = None, search: V | None = None) -> V:
    if not _exact(mode) or not _exact(search, (1.0,)):
        return error("MATCH: exact matches only")
    position = c.tables[keys.name].position
    found = c._found(c._plain(x), keys, keys.columns[0], {position: F.col(f"`{position}`").cast("double")})
    out = c._result(keys, position, found, lost="MATCH: value not found")
    return V(found[position], NUM, out.err, strict=True, depth=out.depth)


def _index(c: Compiler, table: Range, row: V, column: V | None = None) -> V:
    j = 1.0 if column is None else column.literal
    if not isinstance(j, float) or not 1 <= int(j) <= len(table.columns):
        return error("INDEX: column out of bounds")
    name, position = table.columns[int(j) - 1], c.tables[table.name].position
    n = number_arg(c._plain(row))
    key = V(F.floor(n.col).cast("double"), NUM, n.err, strict=True, depth=c._plain(row).depth)
    return c._result(table, name, c._found(key, table, position, {name: F.col(f"`{name}`")}), lost="INDEX: row out of bounds")


def _rank(average: bool):
    def run(c: Compiler, x: V, values: Range | V, order: V | None = None) -> V:
        return _placed(c, x, values, lambda df: op.value_ranks(df, "__v", bool(order is not None and order.literal)), "rank_avg" if average else "rank_eq")

    return run


def _percent_rank(column: str):
    def run(c: Compiler, values: Range | V, x: V, digits: V | None = None) -> V:
        return _placed(c, x, values, lambda df: op.value_percents(df, "__v", 3 if digits is None else int(digits.literal)), column)

    return run


def _placed(c: Compiler, x: V, values: Range | V, places: Callable[[DataFrame], DataFrame], column: str) -> V:
    """Where x stands among the values, which it must be one of."""
    if isinstance(values, Range):
        df, of = (c._table(values)[0] if values.name is not None else c.df), values.columns[0]
        v = of_column(F.col(f"`{of}`"), df.schema[of].dataType)
    else:
        df, v = c.df, values
    ranked = places(df.select(number(v).alias("__v"))).select("__v", column)
    at = f"__PLACES{c.made}"
    c.tables[at] = Table(ranked.withColumn("__position", F.lit(1)), "__position")
    r = Range(at, [column])
    key = number_arg(c._plain(x))
    key.depth = c._plain(x).depth
    return c._result(r, column, c._found(key, r, "__v", {column: F.col(column)}))


def _database(name: str):
    def run(c: Compiler, table: Range, of: V, criteria: V) -> V:
        if table.name is not None:
            raise FormulaError(f"{name} works on the table that is summarized")
        columns = {k.upper(): k for k in c.df.columns}
        key = c.df.columns[int(of.literal) - 1] if isinstance(of.literal, float) else columns.get(str(of.literal).upper())
        if key is None or not isinstance(criteria.literal, (list, dict)):
            return error(f"{name}: no such field or criteria")
        rows = criteria.literal if isinstance(criteria.literal, list) else [criteria.literal]
        out = op.database_column(c.df, rows, name, key)
        kind = of_column(F.col(f"`{key}`"), c.df.schema[key].dataType).kind if name == "DGET" else NUM
        return V(out, kind, F.when(out.isNull(), F.lit(VALUE_ERROR if name == "DGET" else NUM_ERROR)), aggregate=True, strict=True)

    return run


def _row(c: Compiler, of: V | None = None) -> V:
    return error("ROW: the rows have no numbers") if c.position is None else V(F.col(f"`{c.position}`").cast("double"), NUM)


def _sheets(c: Compiler) -> list[str]:
    return [k for k in c.tables if not k.startswith("__")]


#: Functions of ranges and of the compiler's own tables.
TABLE_CALLS: dict[str, Callable] = {
    "VLOOKUP": _vlookup, "HLOOKUP": _hlookup, "XLOOKUP": _xlookup, "MATCH": _match, "XMATCH": _match, "INDEX": _index,
    "RANK": _rank(False), "RANK.EQ": _rank(False), "RANK.AVG": _rank(True), "PERCENTRANK": _percent_rank("rank_inc"), "PERCENTRANK.INC": _percent_rank("rank_inc"), "PERCENTRANK.EXC": _percent_rank("rank_exc"),
    "ROW": _row, "COLUMNS": lambda c, r: lit(float(len(r.columns) if isinstance(r, Range) else 1)),
    "SHEETS": lambda c, r=None: lit(float(len(_sheets(c)) + 1) if r is None else 1.0), "SHEET": lambda c, name=None: lit(1.0) if name is None else lit(float(_sheets(c).index(str(name.literal).upper()) + 2)) if str(name.literal).upper() in _sheets(c) else error(NA),
} | {k: _database(k) for k in ("DSUM", "DAVERAGE", "DPRODUCT", "DSTDEV", "DSTDEVP", "DVAR", "DVARP", "DMAX", "DMIN", "DCOUNT", "DCOUNTA", "DGET")}


def calculate(df: DataFrame, formulas: dict[str, str], names: dict[str, object] | None = None, errors: bool = False, tables: dict[str, Table] | None = None, position: str | None = None) -> DataFrame:
    """Adds a column for each formula of a row's cells; with ``errors`` also ``<name>_err``, the error or null.

    A formula may use the columns that those before it add.
    """
    todo = list(formulas.items())
    while todo:
        c, columns, out = Compiler(df, names, tables, position), list(df.columns), {}
        while todo and not (out and _uses(todo[0][1], out)):
            k, f = todo.pop(0)
            v = c.compile(f)
            if v.aggregate:
                raise FormulaError(f"{f}: an aggregate has no row")
            out[k] = v.value()
            if errors:
                out[f"{k}_err"] = v.err if v.err is not None else F.lit(None).cast("string")
        ready = c.prepare(df)
        rest = [F.col(f"`{k}`") for k in columns if k not in out]
        df = ready.select(*rest, *[v.alias(k) for k, v in out.items()]) if c.steps else df.withColumns(out)
    return df


def _uses(source: str, made: dict) -> bool:
    names = {k.upper() for k in made}
    return any(kind == "name" and re.split(r"[\[\]@]", s)[-2 if "[" in s else 0].strip().upper() in names for kind, s in tokenize(source))


#: Aggregates that look at a group's numbers in order: (kind, k) of their further arguments.
ORDER_STATISTICS: dict[str, Callable] = {
    "MEDIAN": lambda a: ("inc", 0.5), **dict.fromkeys(("PERCENTILE", "PERCENTILE.INC"), lambda a: ("inc", a[0])), **dict.fromkeys(("QUARTILE", "QUARTILE.INC"), lambda a: ("inc", a[0] / 4)), "PERCENTILE.EXC": lambda a: ("exc", a[0]),
    "QUARTILE.EXC": lambda a: ("exc", a[0] / 4), "SMALL": lambda a: ("small", int(a[0])), "LARGE": lambda a: ("large", int(a[0])), "TRIMMEAN": lambda a: ("trim", a[0]),
}


def summarize(df: DataFrame, formulas: dict[str, str], by: list[str] | None = None, names: dict[str, object] | None = None, order: str | None = None, large_groups: bool | None = None) -> DataFrame:
    """Aggregate formulas over all rows or over each group; ``order`` is the column that says which row's cash flow
    comes first.

    One pass serves small groups, whose numbers fit a task.  With ``large_groups``, which holds by default where there
    is but one group, statistics of the order (medians, percentiles, k-th numbers, trimmed means) come from counts of
    the different values instead, so that no task holds a group's numbers.
    """
    c = Compiler(df, names, order=order)
    if not by if large_groups is None else large_groups:
        c.groups = list(by or [])
    columns: list[Column] = [c.compile(f).value().alias(k) for k, f in formulas.items()]
    return c._join_statistics(c.prepare(df)).groupBy(*(by or [])).agg(*columns)


def supported() -> list[str]:
    """Names of all functions that formulas may call."""
    return sorted({*SCALARS, *AGGREGATES, *TABLE_CALLS, "COLUMN"})


__all__ = ["Compiler", "FormulaError", "Table", "calculate", "parse", "summarize", "supported", "tokenize"]
