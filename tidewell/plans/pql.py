"""The pipeline language: text to a list of operations, applied to DataFrames in written order.

QUERY source [AS a] followed by any of: WHERE cond | SELECT items | COMPUTE name = expr, ... | [INNER|LEFT|RIGHT|FULL|CROSS] JOIN source [AS b]
[ON cond] | GROUP BY exprs (the COMPUTE that follows aggregates) | HAVING cond | QUALIFY cond | ORDERBY or ORDER BY items | LIMIT n [OFFSET m] |
TAKE n | SKIP n | UNWIND array AS name | [NOT] SIMILAR TO vector [IN field] [TOP k] [THRESHOLD t] [METRIC m] | SEARCH 'words' [IN field] [TOP k] |
HYBRID SEARCH 'words' [IN field] SIMILAR TO vector [IN field] [ALPHA a] [TOP k] | TRAVERSE edges [WHERE cond] DEPTH a [TO b] [SHORTEST|ALL|ANY] |
PATH [SHORTEST|ALL] FROM x TO y IN edges [DEPTH n] | [OPTIONAL] MATCH pattern.

A source is a name [(TENANT 't')] [VERSION n], inline rows [{...}, ...], several names (a, b), or a query in parentheses. A vector is a list, a
parameter, or CENTROID(query [, field]). A pattern is (a)-[e:edges]->(b)<-[:edges*1..3]-(c:people), nodes being values of src and dst, those
with a label rows of that table by its first column. Queries in parentheses are values, EXISTS(query) and IN (query) tests; they see the columns of the query around them.

INSERT INTO name {...}, ... | UPDATE name SET a = expr, ... [WHERE cond] | DELETE FROM name [WHERE cond] | CREATE NODE name {...} |
CREATE EDGE name FROM x TO y [WEIGHT w] change stored tables and give the number of rows. EXPLAIN before a query gives its plan.

Parameters are @name, unbound ones null. Comments are -- and /* */. Words of the language are words only where they can stand, so any may name a column.
Unary minus and NOT bind tightest, then ^ (right-associative), then * / %, then + -, then comparisons, AND, OR. Whole numbers divide to whole numbers;
division by zero gives null. + joins texts. Comparisons with null are null. Aggregates and windows, f(x) OVER (PARTITION BY .. ORDER BY .. ROWS ..), may stand anywhere in a COMPUTE.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as texts
from tidewell.functions import vectors
from tidewell.operators import graph
from tidewell.sources import catalog as sources
from tidewell.sources.catalog import Catalog

TOKEN = re.compile(r"""\s+|--(?![>\[(])[^\n]*|/\*.*?\*/|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<par>@\w+)|(?P<id>[A-Za-z_]\w*)|(?P<op>==|!=|<>|<=|>=|\.\.|[-+*/%^=<>()\[\],.{}:|])""", re.S)
AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "COLLECT": F.collect_list, "ARRAY_AGG": F.collect_list, "STDDEV": F.stddev_samp, "VARIANCE": F.var_samp, "APPROX_DISTINCT": F.approx_count_distinct, "PERCENTILE": lambda x, p: F.percentile(x, p), "STRING_AGG": F.listagg}
WINDOWS = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "PERCENT_RANK": F.percent_rank, "CUME_DIST": F.cume_dist, "NTILE": F.ntile, "LAG": F.lag, "LEAD": F.lead, "FIRST_VALUE": F.first, "LAST_VALUE": F.last, "NTH_VALUE": F.nth_value}
#: Functions that take plain numbers where others take columns, by the place of the first such argument.
PLAIN_FROM = {"NTILE": 0, "LAG": 1, "LEAD": 1, "NTH_VALUE": 1, "EMBED": 1}
FUNCTIONS = {
    "SIZE": F.size, "UPPER": F.upper, "LOWER": F.lower, "CONCAT": F.concat, "SUBSTRING": F.substring, "TRIM": F.trim, "LTRIM": F.ltrim, "RTRIM": F.rtrim, "REPLACE": F.replace, "SPLIT": F.split, "REVERSE": F.reverse, "NOW": F.current_timestamp, "DATE": F.to_date, "TIMESTAMP": F.to_timestamp, "SECOND": F.second, "MINUTE": F.minute, "HOUR": F.hour, "DAY": F.day, "MONTH": F.month, "YEAR": F.year,
    "YEAR_DIFF": lambda a, b: F.floor(F.months_between(a, b) / 12), "DAYS_SINCE": lambda d: F.datediff(F.current_date(), d), "DATE_ADD": F.date_add, "DATE_SUB": F.date_sub, "DATE_DIFF": F.datediff, "DATE_FORMAT": F.date_format, "DATE_TRUNC": lambda unit, d: F.call_function("date_trunc", unit, d), "EXTRACT": lambda part, d: F.extract(part, d),
    "SLICE": lambda a, s, e: F.slice(a, s + 1, e - s), "ARRAY_CONTAINS": F.array_contains, "APPEND": F.array_append, "DISTINCT_VALUES": F.array_distinct, "FLATTEN": F.flatten, "JOIN": F.array_join, "SORT": F.array_sort, "FIRST": lambda a: F.get(a, F.lit(0)), "LAST": lambda a: F.try_element_at(a, F.lit(-1)),
    "UUID": F.uuid, "HASH": F.xxhash64, "RANDOM": F.rand, "COALESCE": F.coalesce, "NULLIF": F.nullif, "GREATEST": F.greatest, "LEAST": F.least, "MD5": F.md5, "SHA256": lambda x: F.sha2(x, 256),
    "ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": F.round, "SQRT": F.sqrt, "POWER": F.pow, "EXP": F.exp, "LN": F.ln, "LOG10": F.log10, "SIGN": F.sign, "MOD": F.try_mod, "CONTAINS": F.contains, "STARTS_WITH": F.startswith, "ENDS_WITH": F.endswith, "MATCHES": F.rlike,
    "VECTOR_DISTANCE": vectors.distance, "DISTANCE": vectors.distance, "COSINE_SIMILARITY": vectors.cosine, "DOT_PRODUCT": vectors.dot, "NORMALIZE": vectors.normalize, "VECTOR_SCORE": lambda: F.col("_vector_score"), "TEXT_SCORE": lambda: F.col("_text_score"),
    "EMBED": lambda x, n=64: vectors.embedded(x, n), "PATH_NODES": lambda p: p, "PATH_LENGTH": lambda p: F.size(p) - 1, "PATH_CONTAINS_CYCLE": lambda p: F.size(F.array_distinct(p)) < F.size(p),
    "PATH_EDGES": lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: F.struct(x.alias("src"), F.get(p, i + 1).alias("dst"))),
}


class PqlError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise PqlError(f"unexpected character {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


@dataclass
class Expr:
    """A column and whether it is made of whole numbers or aggregates."""

    col: Column
    whole: bool = False
    agg: bool = False
    name: str | None = None
    text: bool = False
    plain: Any = None  # the number itself of a literal


class Parser:
    def __init__(self, text: str, params: dict[str, Any] | None = None, catalog: Catalog | None = None):
        self.toks, self.at, self.params, self.catalog = tokens(text), 0, params or {}, catalog
        self.df: DataFrame | None = None  # the frame that expressions are over
        self.outer: list[DataFrame] = []  # the frames of the queries around
        self.bound: dict[str, Column] = {}  # names of elements within ANY and ALL

    def kind(self, c: Column) -> T.DataType | None:
        """The type of an expression over the current frame; None where it has none by itself."""
        if self.df is None or self.outer:
            return None
        try:
            return self.df.select(c.alias("x")).schema["x"].dataType
        except AnalysisException:
            return None

    def subquery(self) -> DataFrame:
        """A query up to its closing parenthesis, which stays."""
        held, self.outer = self.df, ([self.df] if self.df is not None else []) + self.outer
        self.need("QUERY")
        out = steps(self)
        self.df, self.outer = held, self.outer[1:] if held is not None else self.outer
        return out

    def looks_at_query(self) -> bool:
        return self.peek().upper() == "QUERY" and self.at + 1 < len(self.toks) and (self.toks[self.at + 1][0] == "id" or self.peek(1) in "[(")

    def peek(self, ahead: int = 0) -> str:
        return self.toks[self.at + ahead][1] if self.at + ahead < len(self.toks) else ""

    def word(self, *words: str) -> bool:
        """Takes the words if they stand here."""
        for i, w in enumerate(words):
            if self.at + i >= len(self.toks) or self.toks[self.at + i][0] == "str" or self.peek(i).upper() != w:
                return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.word(*words):
            raise PqlError(f"expected {' '.join(words)}, found {self.peek() or 'the end'}")

    def take(self, kind: str) -> str:
        if self.at >= len(self.toks) or self.toks[self.at][0] != kind:
            raise PqlError(f"expected {kind}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.toks[self.at - 1][1]

    def items(self, one) -> list:
        out = [one()]
        while self.word(","):
            out.append(one())
        return out

    # expressions, loosest first
    def expr(self) -> Expr:
        left = self.conj()
        while self.word("OR"):
            right = self.conj()
            left = Expr(left.col | right.col, agg=left.agg or right.agg)
        return left

    def conj(self) -> Expr:
        left = self.comparison()
        while self.word("AND"):
            right = self.comparison()
            left = Expr(left.col & right.col, agg=left.agg or right.agg)
        return left

    def comparison(self) -> Expr:
        if self.word("NOT"):
            e = self.comparison()
            return Expr(~e.col, agg=e.agg)
        if self.peek().upper() == "EXISTS" and self.peek(1) in ("(", "{"):
            self.at += 2
            found = self.subquery()
            self.close()
            return Expr(found.exists())
        if self.peek().upper() in ("ANY", "ALL") and self.peek(1) == "(" and self.peek(3).upper() == "IN":
            return self.quantified()
        left = self.sum()
        if self.word("IS", "NOT", "NULL"):
            return Expr(left.col.isNotNull(), agg=left.agg)
        if self.word("IS", "NULL"):
            return Expr(left.col.isNull(), agg=left.agg)
        negated = self.word("NOT")
        out, agg = None, left.agg
        if self.word("IN"):
            out = self.member(left)
        elif self.word("BETWEEN"):
            low = self.sum()
            self.need("AND")
            high = self.sum()
            out, agg = left.col.between(low.col, high.col), agg or low.agg or high.agg
        elif self.word("LIKE"):
            out = left.col.like(self._text(self.take("str")))
        elif self.word("CONTAINS"):
            right = self.sum().col
            out = F.array_contains(left.col, right) if isinstance(self.kind(left.col), T.ArrayType) else F.contains(left.col, right)
        elif self.word("STARTS", "WITH"):
            out = F.startswith(left.col, self.sum().col)
        elif self.word("ENDS", "WITH"):
            out = F.endswith(left.col, self.sum().col)
        elif self.word("MATCHES"):
            out = F.rlike(left.col, self.sum().col)
        if out is not None:
            return Expr(~out if negated else out, agg=agg)
        if negated:
            raise PqlError(f"unexpected {self.peek() or 'the end'} after NOT")
        for op, f in (("==", "__eq__"), ("=", "__eq__"), ("!=", "__ne__"), ("<>", "__ne__"), ("<=", "__le__"), (">=", "__ge__"), ("<", "__lt__"), (">", "__gt__")):
            if self.peek() == op and self.toks[self.at][0] == "op":
                self.at += 1
                right = self.sum()
                return Expr(getattr(left.col, f)(right.col), agg=left.agg or right.agg)
        return left

    def close(self) -> None:
        if self.peek() not in (")", "}"):
            raise PqlError(f"expected ), found {self.peek() or 'the end'}")
        self.at += 1

    def member(self, left: Expr) -> Column:
        """IN a list, a query, or an array column."""
        if self.peek() not in ("(", "["):
            return F.array_contains(self.sum().col, left.col)
        end = ")" if self.peek() == "(" else "]"
        self.at += 1
        if self.looks_at_query():
            found = self.subquery()
            self.need(end)
            outside = left.col.outer() if self.df is not None else left.col
            return found.where(found[found.columns[0]] == outside).exists()
        own = self.items(self.expr)
        self.need(end)
        return left.col.isin(*[e.col for e in own])

    def quantified(self) -> Expr:
        """ANY(x IN array WHERE cond) and ALL(...)."""
        some = self.take("id").upper() == "ANY"
        self.need("(")
        name = self.take("id")
        self.need("IN")
        over = self.sum().col
        self.need("WHERE")
        begin = self.at

        def test(x: Column) -> Column:
            self.at = begin
            self.bound[name] = x
            out = self.expr().col
            del self.bound[name]
            return out

        out = (F.exists if some else F.forall)(over, test)
        self.need(")")
        return Expr(out)

    def sum(self) -> Expr:
        left = self.product()
        while self.peek() in ("+", "-") and self.toks[self.at][0] == "op":
            plus = self.take("op") == "+"
            right = self.product()
            if plus and (left.text or right.text or isinstance(self.kind(left.col), T.StringType) or isinstance(self.kind(right.col), T.StringType)):
                left = Expr(F.concat(left.col.cast("string"), right.col.cast("string")), agg=left.agg or right.agg, text=True)
            else:
                left = Expr(left.col + right.col if plus else left.col - right.col, left.whole and right.whole, left.agg or right.agg)
        return left

    def product(self) -> Expr:
        left = self.power()
        while self.peek() in ("*", "/", "%") and self.toks[self.at][0] == "op":
            op = self.take("op")
            right = self.power()
            both = self.is_whole(left) and self.is_whole(right)
            if op == "/":  # whole numbers divide toward zero without passing through fractions
                col = F.when(right.col != 0, F.call_function("div", left.col, right.col)) if both else F.try_divide(left.col.cast("double"), right.col.cast("double"))
            else:
                col = left.col * right.col if op == "*" else F.try_mod(left.col, right.col)
            left = Expr(col, both, left.agg or right.agg)
        return left

    def is_whole(self, e: Expr) -> bool:
        return e.whole or isinstance(self.kind(e.col), T.IntegralType)

    def power(self) -> Expr:
        left = self.unary()
        if self.peek() == "^":
            self.at += 1
            right = self.power()
            return Expr(F.pow(left.col, right.col), agg=left.agg or right.agg)
        return left

    def unary(self) -> Expr:
        if self.peek() == "-":
            self.at += 1
            e = self.unary()
            return Expr(-e.col, e.whole, e.agg)
        return self.atom()

    def _text(self, raw: str) -> str:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), raw[1:-1])

    def atom(self) -> Expr:
        if self.at >= len(self.toks):
            raise PqlError("unexpected end")
        kind, raw = self.toks[self.at]
        self.at += 1
        if kind == "num":
            return Expr(F.lit(int(raw)), True, plain=int(raw)) if raw.isdigit() else Expr(F.lit(float(raw)), plain=float(raw))
        if kind == "str":
            return Expr(F.lit(self._text(raw)), text=True, plain=self._text(raw))
        if kind == "par":
            value = self.params.get(raw[1:])
            return Expr(F.lit(value), isinstance(value, int) and not isinstance(value, bool), text=isinstance(value, str), plain=value)
        if raw == "(":
            if self.looks_at_query():
                found = self.subquery()
                self.need(")")
                return Expr(found.scalar())
            e = self.expr()
            self.need(")")
            return e
        if raw == "[":
            if self.word("]"):
                return Expr(F.array())
            own = self.items(self.expr)
            self.need("]")
            return Expr(F.array(*[e.col for e in own]))
        if raw == "{":
            pair = lambda: (self.take("id"), self.need(":"), self.expr())
            own = self.items(pair)
            self.need("}")
            return Expr(F.struct(*[e.col.alias(k) for k, _, e in own]))
        if kind != "id":
            raise PqlError(f"unexpected {raw}")
        upper = raw.upper()
        if upper in ("TRUE", "FALSE", "NULL"):
            return Expr(F.lit({"TRUE": True, "FALSE": False, "NULL": None}[upper]))
        if upper == "CASE":
            return self.case()
        if self.peek() == "(":
            return self.call(upper)
        name = raw
        while self.peek() == "." and self.at + 1 < len(self.toks) and self.toks[self.at + 1][0] == "id":
            name += "." + self.peek(1)
            self.at += 2
        if raw in self.bound:
            return Expr(reduce(lambda c, part: c[part], name.split(".")[1:], self.bound[raw]))
        return Expr(self.column(name), name=name.split(".")[-1])

    def column(self, name: str) -> Column:
        """A column of this query, or else of one around it."""
        if self.outer and not _has(self.df, name) and any(_has(df, name) for df in self.outer):
            return F.col(name).outer()
        return F.col(name)

    def case(self) -> Expr:
        out, last = None, F.lit(None)
        while self.word("WHEN"):
            cond = self.expr().col
            self.need("THEN")
            then = self.expr().col
            out = F.when(cond, then) if out is None else out.when(cond, then)
        if self.word("ELSE"):
            last = self.expr().col
        self.need("END")
        return Expr(out.otherwise(last))

    def call(self, name: str) -> Expr:
        self.need("(")
        if name == "GRAPH_CENTRALITY":
            return self.centrality()
        if name == "CONNECTED":
            return self.connected()
        distinct = self.word("DISTINCT")
        if name == "COUNT" and (self.word("*", ")") or self.word(")")):
            return self.over(F.count(F.lit(1)), True)
        args = [] if self.word(")") else self.items(self.expr)
        if args:
            self.need(")")
        plain = PLAIN_FROM.get(name, len(args))
        cols = [a.col if i < plain or a.plain is None else a.plain for i, a in enumerate(args)]
        if name in AGGREGATES:
            if distinct:
                return self.over(F.count_distinct(*cols) if name == "COUNT" else F.collect_set(*cols) if name in ("COLLECT", "ARRAY_AGG") else AGGREGATES[name](F.expr("1")) if not cols else _distinct(name)(*cols), name == "COUNT")
            return self.over(AGGREGATES[name](*cols), name == "COUNT")
        if name in WINDOWS:
            return self.over(WINDOWS[name](*cols), False, True)
        if name == "LENGTH":
            kind = self.kind(cols[0])
            return Expr(F.size(cols[0]) if isinstance(kind, (T.ArrayType, T.MapType)) else F.char_length(cols[0]), True, any(a.agg for a in args))
        if name in FUNCTIONS:
            return Expr(FUNCTIONS[name](*cols), agg=any(a.agg for a in args), text=name in ("UPPER", "LOWER", "CONCAT", "SUBSTRING", "TRIM", "REPLACE"))
        if self.catalog is not None and self.catalog.spark.catalog.functionExists(name.lower()):
            return Expr(F.call_function(name.lower(), *cols), agg=any(a.agg for a in args))
        raise PqlError(f"unknown function {name}")

    def over(self, col: Column, whole: bool, must: bool = False) -> Expr:
        """An aggregate, or with OVER (...) a window expression."""
        if not self.word("OVER"):
            if must:
                raise PqlError("a window function needs OVER")
            return Expr(col, whole, True)
        self.need("(")
        by, order = [], []
        if self.word("PARTITION", "BY"):
            by = [e.col for e in self.items(self.expr)]
        if self.word("ORDER", "BY"):
            order = self.items(self.sort_key)
        w = Window.partitionBy(*by)
        w = w.orderBy(*order) if order else w
        if (mode := self.peek().upper()) in ("ROWS", "RANGE"):
            self.at += 1
            if self.word("BETWEEN"):
                low = self.bound_of()
                self.need("AND")
                high = self.bound_of()
            else:
                low, high = self.bound_of(), 0
            w = w.rowsBetween(low, high) if mode == "ROWS" else w.rangeBetween(low, high)
        self.need(")")
        return Expr(col.over(w), whole)

    def bound_of(self) -> int:
        if self.word("CURRENT", "ROW"):
            return 0
        if self.word("UNBOUNDED", "PRECEDING"):
            return Window.unboundedPreceding
        if self.word("UNBOUNDED", "FOLLOWING"):
            return Window.unboundedFollowing
        n = int(self.take("num"))
        return -n if self.word("PRECEDING") else (self.need("FOLLOWING"), n)[1]

    def sort_key(self) -> Column:
        e = self.expr().col
        if self.word("DESC"):
            return e.desc_nulls_last()
        self.word("ASC")
        return e.asc_nulls_first()

    def centrality(self) -> Expr:
        """GRAPH_CENTRALITY(edges [, key [, 'pagerank' | 'degree' | 'closeness']]): the measure of the node that key, by default the first column, names; 0 for others."""
        edges = self.catalog.resolve(self.take("id"))
        key = self.expr().col if self.word(",") else F.col(self.df.columns[0])
        metric = self._text(self.take("str")).lower() if self.word(",") else "pagerank"
        self.need(")")
        made = {"pagerank": lambda: graph.pagerank(edges).withColumnRenamed("rank", "v"), "degree": lambda: graph.degrees(edges).select("node", F.col("degree").alias("v")), "closeness": lambda: graph.closeness(edges).withColumnRenamed("closeness", "v")}
        name = f"__centrality_{len(self.df.columns)}"
        found = made[metric]().select(F.col("node").alias(f"{name}_node"), F.col("v").alias(name))
        self.df = self.df.join(found, key == F.col(f"{name}_node"), "left").drop(f"{name}_node")
        return Expr(F.coalesce(F.col(name), F.lit(0.0)))

    def connected(self) -> Expr:
        """CONNECTED(a, b, edges): whether the nodes lie in one component, edges taken both ways."""
        from tidewell.operators.components import components

        a, _, b, _, edges = self.expr().col, self.need(","), self.expr().col, self.need(","), self.catalog.resolve(self.take("id"))
        self.need(")")
        found, name = components(edges), f"__component_{len(self.df.columns)}"
        for k, key in (("a", a), ("b", b)):
            self.df = self.df.join(found.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(f"{name}_{k}")), key == F.col(f"{name}_node"), "left").drop(f"{name}_node")
        return Expr(F.coalesce((a == b) | (F.col(f"{name}_a") == F.col(f"{name}_b")), F.lit(False)))


def _distinct(name: str):
    return {"SUM": F.sum_distinct, "AVG": lambda x: F.try_divide(F.sum_distinct(x), F.count_distinct(x)), "MIN": F.min, "MAX": F.max}[name]


def _has(df: DataFrame | None, name: str) -> bool:
    if df is None:
        return False
    try:
        df.select(F.col(name))
        return True
    except AnalysisException:
        return False


def run(text: str, catalog: Catalog, params: dict[str, Any] | None = None) -> DataFrame:
    p = Parser(text, params, catalog)
    if p.peek().upper() in ("INSERT", "UPDATE", "DELETE", "CREATE"):
        return change(p)
    explain = p.word("EXPLAIN")
    p.need("QUERY")
    df = steps(p)
    if p.at < len(p.toks):
        raise PqlError(f"unexpected {p.peek()}")
    if explain:
        plan = df._jdf.queryExecution().toString()
        return catalog.spark.createDataFrame([(line,) for line in plan.splitlines()], "plan string")
    return df


def _source(p: Parser) -> tuple[DataFrame, str]:
    catalog = p.catalog
    if p.peek() == "[":
        p.at += 1
        rows = p.items(lambda: _object(p))
        p.need("]")
        df, name = _rows(catalog, rows), "inline"
    elif p.peek() == "(":
        p.at += 1
        if p.looks_at_query():
            df, name = p.subquery(), "query"
        else:
            df, name = sources.union_sources(*p.items(lambda: catalog.resolve(_dotted(p)))), "union"
        p.need(")")
    else:
        name = _dotted(p)
        if p.word("VERSION"):  # a number or a tag
            v = p.take(p.toks[p.at][0])
            df = catalog.at_version(name, int(v) if v.isdigit() else v.strip("'\""))
        else:
            df = catalog.resolve(name)
        if p.word("(", "TENANT"):
            df = sources.tenant(df, p._text(p.take("str")))
            p.need(")")
    alias = p.take("id") if p.word("AS") else name.split(".")[-1]
    return df.alias(alias), alias


def _dotted(p: Parser) -> str:
    name = p.take("id")
    while p.peek() == ".":
        name += p.take("op") + p.take("id")
    return name


def _object(p: Parser) -> dict[str, Column]:
    def pair() -> tuple[str, Column]:
        name = p.take("id") if p.toks[p.at][0] == "id" else p._text(p.take("str"))
        p.need(":")
        return name, p.expr().col

    p.need("{")
    out = dict(p.items(pair))
    p.need("}")
    return out


def _rows(catalog: Catalog, rows: list[dict[str, Column]]) -> DataFrame:
    """A frame of literal rows; fields that a row lacks are null."""
    return sources.union_sources(*[catalog.spark.range(1).select(*[c.alias(k) for k, c in r.items()]) for r in rows])


def steps(p: Parser) -> DataFrame:
    """The source and all clauses that follow, up to the end or a closing parenthesis."""
    catalog = p.catalog
    df, _ = _source(p)
    keys: list[Column] | None = None
    while p.at < len(p.toks) and p.peek() not in (")", "}"):
        p.df = df
        if p.word("WHERE") or p.word("HAVING"):
            cond = p.expr().col
            df = p.df.where(cond).select(*df.columns) if p.df is not df else df.where(cond)
        elif p.word("QUALIFY"):
            cond = p.expr().col
            df = p.df.withColumn("__qualified", cond).where("__qualified").select(*df.columns)
        elif p.word("SELECT"):
            own = p.items(lambda: _item(p, df.columns))
            df = p.df.select(*[c for one in own for c in (one if isinstance(one, list) else [one])])
        elif p.word("COMPUTE"):
            before = df.columns
            if keys is not None:
                named = p.items(lambda: (p.take("id"), p.need("="), p.expr()))
                df, keys = p.df.groupBy(*keys).agg(*[e.col.alias(n) for n, _, e in named]), None
                continue
            aggregated: list[Column] = []
            while True:  # later ones see earlier ones
                name = p.take("id")
                p.need("=")
                e = p.expr()
                if e.agg:
                    aggregated.append(e.col.alias(name))
                else:
                    p.df = p.df.withColumn(name, e.col)
                    before = before if name in before else [*before, name]
                if not p.word(","):
                    break
            df = p.df.agg(*aggregated) if aggregated else p.df if len(p.df.columns) == len(before) else p.df.select(*before)
        elif (how := next((h for h in ("INNER", "LEFT", "RIGHT", "FULL", "CROSS") if p.peek().upper() == h and p.peek(1).upper() == "JOIN"), None)) or p.peek().upper() == "JOIN":
            p.at += 2 if how else 1
            right, _ = _source(p)
            clash = set(df.columns) & set(right.columns)
            cond = p.expr().col if p.word("ON") else None
            joined = df.join(right, cond, (how or "inner").lower()) if cond is not None else df.crossJoin(right)
            left_cols = [F.col(c) if c not in clash else df[c] for c in df.columns]
            df = joined.select(*left_cols, *[right[c].alias(f"right_{c}" if c in clash else c) for c in right.columns])
        elif p.word("GROUP", "BY"):
            own = p.items(p.expr)
            keys = [e.col.alias(e.name) if e.name else e.col for e in own]
        elif p.word("ORDERBY") or p.word("ORDER", "BY"):
            own = p.items(p.sort_key)
            df = p.df.orderBy(*own)
        elif p.word("LIMIT") or p.word("TAKE"):
            n = int(p.take("num"))
            df = df.offset(int(p.take("num"))).limit(n) if p.word("OFFSET") else df.limit(n)
        elif p.word("SKIP"):
            df = df.offset(int(p.take("num")))
        elif p.word("UNWIND"):
            e = p.expr().col
            p.need("AS")
            df = df.select("*", F.explode(e).alias(p.take("id")))
        elif p.word("NOT", "SIMILAR", "TO"):
            df = _similar(p, df, False)
        elif p.word("SIMILAR", "TO"):
            df = _similar(p, df)
        elif p.word("HYBRID", "SEARCH"):
            df = _hybrid(p, df)
        elif p.word("SEARCH"):
            df = _search(p, df)
        elif p.word("TRAVERSE"):
            df = _traverse(p, df, catalog)
        elif p.word("PATH"):
            df = _path(p)
        elif p.word("OPTIONAL", "MATCH"):
            df = _match(p, df, True)
        elif p.word("MATCH"):
            df = _match(p, df, False)
        else:
            raise PqlError(f"unexpected {p.peek()}")
    if keys is not None:
        df = df.groupBy(*keys).agg(F.count("*").alias("count"))
    p.df = df
    return df


def _item(p: Parser, columns: list[str]) -> Column | list[Column]:
    if p.word("*"):
        return [F.col(f"`{c}`") for c in columns]
    if p.at + 1 < len(p.toks) and p.toks[p.at][0] == "id" and p.peek(1) == "=":
        name = p.take("id")
        p.at += 1
        return p.expr().col.alias(name)
    e = p.expr()
    return e.col.alias(p.take("id")) if p.word("AS") else e.col.alias(e.name) if e.name else e.col


def _vector(p: Parser) -> list[float] | None:
    """A list, a parameter, or the centroid of a query's vectors; None where there are none."""
    if p.toks[p.at][0] == "par":
        return list(p.params[p.take("par")[1:]])
    if p.word("CENTROID", "("):
        found = p.subquery()
        field = p.take("id") if p.word(",") else "embedding"
        p.need(")")
        one = vectors.centroid(found.where(F.col(field).isNotNull()), field, []).first()  # one row
        return list(one["centroid"]) if one and one["centroid"] else None
    p.need("[")
    out = p.items(lambda: float(("-" if p.word("-") else "") + p.take("num")))
    p.need("]")
    return out


def _number(p: Parser) -> float:
    return float(("-" if p.word("-") else "") + p.take("num"))


def _similar(p: Parser, df: DataFrame, near: bool = True) -> DataFrame:
    """The nearest rows; with NOT those whose score is below the threshold (0.5 by default), or that have no vector."""
    query, field, k, threshold, most, metric = _vector(p), "embedding", 10, None, None, "cosine"
    while p.peek().upper() in ("IN", "TOP", "THRESHOLD", "MOST", "METRIC"):
        if p.word("IN"):
            field = p.take("id")
        elif p.word("TOP"):
            k = int(p.take("num"))
        elif p.word("THRESHOLD"):
            threshold = _number(p)
        elif p.word("MOST"):
            most = _number(p)
        else:
            p.at += 1
            metric = p.take("id").lower()
    if query is None:
        return df.withColumn("_vector_score", F.lit(None).cast("double")).limit(0)
    if not near:
        scored = df.withColumn("_vector_score", vectors.score(metric, F.col(field), vectors.literal(query)))
        return scored.where(F.col("_vector_score").isNull() | (F.col("_vector_score") < (0.5 if threshold is None else threshold)))
    return vectors.top_k(df, query, k, metric, field, threshold, most)


def _words(p: Parser) -> tuple[str, str]:
    words = p._text(p.take("str")) if p.toks[p.at][0] == "str" else str(p.params[p.take("par")[1:]])
    return words, p.take("id") if p.word("IN") else "text"


def _search(p: Parser, df: DataFrame) -> DataFrame:
    """The rows of highest BM25 for any of the words, by the first column as key."""
    words, field = _words(p)
    k = int(p.take("num")) if p.word("TOP") else 10
    key = df.columns[0]
    found = texts.bm25(df, words.split(), key, field).withColumnRenamed("bm25", "_text_score")
    return df.join(found, key).orderBy(F.desc("_text_score"), key).limit(k)


def _hybrid(p: Parser, df: DataFrame) -> DataFrame:
    """alpha times the vector score and the rest times BM25, each over its greatest."""
    words, field = _words(p)
    p.need("SIMILAR", "TO")
    query, at, alpha, k = _vector(p), "embedding", 0.5, 10
    while p.peek().upper() in ("IN", "ALPHA", "TOP"):
        if p.word("IN"):
            at = p.take("id")
        elif p.word("ALPHA"):
            alpha = _number(p)
        else:
            p.at += 1
            k = int(p.take("num"))
    key = df.columns[0]
    near = df.where(F.col(at).isNotNull()).select(key, vectors.score("cosine", F.col(at), vectors.literal(query)).alias("score"))
    found = texts.alpha_fusion(near, texts.bm25(df, words.split(), key, field).withColumnRenamed("bm25", "score"), key, alpha)
    return df.join(found.withColumnRenamed("score", "_hybrid_score"), key).orderBy(F.desc("_hybrid_score"), key).limit(k)


def _traverse(p: Parser, df: DataFrame, catalog: Catalog) -> DataFrame:
    """node and depth; SHORTEST and ALL give paths instead, of least hops to each node or all without cycles."""
    edges = catalog.resolve(_dotted(p))
    if p.word("WHERE"):
        p.df = edges
        edges = edges.where(p.expr().col)
    p.need("DEPTH")
    least = int(p.take("num"))
    most = int(p.take("num")) if p.word("TO") else least
    starts = df.select(F.col(df.columns[0]).alias("node"))
    if p.word("ALL"):
        return graph.paths(edges, starts, least, most)
    if p.word("SHORTEST"):
        every = graph.paths(edges, starts, 1, most)
        best = every.groupBy(F.get("path", F.lit(0)).alias("start"), F.element_at("path", -1).alias("node")).agg(F.min_by(F.struct("path", "cost", "length"), F.struct("length", "cost", "path")).alias("b"))
        return best.select("start", "node", "b.*").where(F.col("length") >= least)
    p.word("ANY")
    return graph.traverse(edges, starts, least, most)


def _path(p: Parser) -> DataFrame:
    """path, cost, length: PATH SHORTEST the cheapest from one node to another, PATH ALL all without cycles within a number of hops."""
    every = p.word("ALL")
    p.word("SHORTEST")
    p.need("FROM")
    a = p.atom().plain
    p.need("TO")
    b = p.atom().plain
    p.need("IN")
    edges = p.catalog.resolve(_dotted(p))
    deep = int(p.take("num")) if p.word("DEPTH") else 4
    if every:
        kind = edges.schema["src"].dataType.simpleString()
        start = p.catalog.spark.createDataFrame([(a,)], f"node {kind}")
        return graph.paths(edges, start, 1, deep).where(F.element_at("path", -1) == F.lit(b))
    return graph.shortest_route(edges, a, b)


def _node(p: Parser) -> tuple[str, str | None]:
    p.need("(")
    name = p.take("id") if p.toks[p.at][0] == "id" else f"__n{p.at}"
    label = _dotted(p) if p.word(":") else None
    p.need(")")
    return name, label


def _match(p: Parser, df: DataFrame, optional: bool) -> DataFrame:
    """Rows joined with what the pattern finds. A node's name that is a column already is that column's value; other names become columns.

    Steps are equi-joins on edges; steps of several hops are cycle-free paths from each node that the steps before found. OPTIONAL keeps rows without a match.
    """
    first, label = _node(p)
    hops = []
    while p.peek() in ("-", "<"):
        back = p.word("<", "-")
        if not back:
            p.need("-")
        p.need("[")
        name = p.take("id") if p.toks[p.at][0] == "id" else None
        p.need(":")
        tables = [_dotted(p)]
        while p.word("|"):
            tables.append(_dotted(p))
        least = most = None
        if p.word("*"):
            least, most = int(p.take("num")), None
            most = int(p.take("num")) if p.word("..") else least
        p.need("]")
        p.need("-")
        on = not back and p.word(">")
        hops.append((name, tables, least, most, "in" if back else "out" if on else "both", _node(p)))
    catalog = p.catalog
    known = set(df.columns)

    def labelled(found: DataFrame, name: str, label: str | None) -> DataFrame:
        if label is None:
            return found
        nodes = catalog.resolve(label)
        return found.join(nodes.select(F.col(nodes.columns[0]).alias("__key"), F.struct(*nodes.columns).alias(f"{name}_node")), F.col(name) == F.col("__key")).drop("__key")

    found, at = None, first
    for name, tables, least, most, way, (to, to_label) in hops:
        edges = sources.union_sources(*[catalog.resolve(t) for t in tables])
        edges = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
        turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
        edges = {"out": edges, "in": turned, "both": edges.unionByName(turned)}[way]
        if found is None:
            found = df.select(first).distinct() if first in known else edges.select(F.col("src").alias(first)).distinct()
            found = labelled(found, first, label)
        if least is None:
            more = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__to"), *([F.struct(*edges.columns).alias(name)] if name else []))
            found = found.join(more, F.col(at) == F.col("__src")).drop("__src")
        else:
            every = graph.paths(edges, found.select(F.col(at).alias("node")).distinct(), least, most).select(F.get("path", F.lit(0)).alias("__src"), F.element_at("path", -1).alias("__to"), *([F.col("path").alias(name)] if name else []))
            found = found.join(every, F.col(at) == F.col("__src")).drop("__src")
        if to in found.columns:
            found = found.where(F.col(to) == F.col("__to")).drop("__to")
        else:
            found = labelled(found.withColumnRenamed("__to", to), to, to_label)
        at = to
    if found is None:
        raise PqlError("a pattern has at least one step")
    shared = [c for c in found.columns if c in known]
    if not shared:
        return found if not optional else df.crossJoin(found)
    return df.join(found, shared, "left" if optional else "inner")


def change(p: Parser) -> DataFrame:
    """Statements that change a stored table; one row with the number of rows changed."""
    catalog, done = p.catalog, lambda n: p.catalog.spark.range(1).select(F.lit(n).cast("long").alias("rows"))
    if p.word("INSERT", "INTO") or p.word("CREATE", "NODE"):
        name = _dotted(p)
        fresh = _rows(catalog, p.items(lambda: _object(p)))
        if catalog.known(name):
            old = catalog.resolve(name)
            fresh = fresh.select(*[(F.col(f.name).cast(f.dataType) if f.name in fresh.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in old.schema], *[c for c in fresh.columns if c not in old.columns])
            catalog.store(name, old.unionByName(fresh, allowMissingColumns=True))
        else:
            catalog.store(name, fresh)
        return done(fresh.count())
    if p.word("CREATE", "EDGE"):
        name = _dotted(p)
        p.need("FROM")
        a = p.sum().col
        p.need("TO")
        b = p.sum().col
        weight = p.sum().col.cast("double") if p.word("WEIGHT") else F.lit(1.0)
        one = catalog.spark.range(1).select(a.alias("src"), b.alias("dst"), weight.alias("weight"))
        catalog.store(name, sources.add_edges(catalog.resolve(name), one) if catalog.known(name) else one)
        return done(1)
    if p.word("UPDATE"):
        name = _dotted(p)
        old = p.df = catalog.resolve(name)
        p.need("SET")
        values = {n: c for n, _, c in p.items(lambda: (p.take("id"), p.need("="), p.expr().col))}
        cond = F.coalesce(p.expr().col, F.lit(False)) if p.word("WHERE") else F.lit(True)
        n = old.where(cond).count()
        types = {f.name: f.dataType for f in old.schema}
        new = [(F.when(cond, values[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)) for c in old.columns]
        catalog.store(name, old.select(*new, *[F.when(cond, v).alias(c) for c, v in values.items() if c not in types]))
        return done(n)
    p.need("DELETE", "FROM")
    name = _dotted(p)
    old = p.df = catalog.resolve(name)
    cond = F.coalesce(p.expr().col, F.lit(False)) if p.word("WHERE") else F.lit(True)
    n = old.where(cond).count()
    catalog.store(name, old.where(~cond))
    return done(n)
