"""Document expressions compiled to columns: {"$add": ["$price", 1]}, "$path.to.field", "$$variable", literals, arrays and objects.

A missing field is null, and null in gives null out unless an operator says otherwise. Everything stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of date formats and their Spark spelling, and names of types.
DATE_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD"}
TYPE_NAMES = {"int": ("tinyint", "smallint", "int"), "long": ("bigint",), "double": ("float", "double"), "string": ("string",), "bool": ("boolean",), "date": ("date", "timestamp", "timestamp_ntz"), "binData": ("binary",)}


class Scope:
    """What "$field" and "$$name" stand for: columns of a frame or fields of one document, and variables."""

    def __init__(self, df: DataFrame | None = None, variables: dict[str, Column] | None = None, current: Column | None = None, fields: list[str] | None = None):
        self.df, self.variables, self.current = df, variables or {}, current
        self.fields = fields if fields is not None else df.columns if df is not None else None

    def bind(self, **more: Column) -> Scope:
        return Scope(self.df, {**self.variables, **more}, self.current, self.fields)

    def field(self, path: str) -> Column:
        head, *rest = path.split(".")
        if self.fields is not None and head not in self.fields:
            return F.lit(None)
        return _descend(self.current[head] if self.current is not None else F.col(f"`{head}`"), rest)

    def whole(self) -> Column:
        return self.current if self.current is not None else F.struct(*[F.col(f"`{c}`") for c in self.df.columns])

    def variable(self, path: str) -> Column:
        head, *rest = path.split(".")
        if head in self.variables:
            return _descend(self.variables[head], rest)
        if head in ("ROOT", "CURRENT"):
            return self.field(".".join(rest)) if rest else self.whole()
        if head in ("NOW", "CLUSTER_TIME"):
            return F.current_timestamp()
        raise ValueError(f"unknown variable $${head}")

    def kind(self, c: Column) -> T.DataType | None:
        """The type of an expression over the frame; None within lambdas."""
        if self.df is None:
            return None
        try:
            return self.df.select(c.alias("x")).schema["x"].dataType
        except AnalysisException:  # a lambda's variable has no type by itself
            return None


def _descend(c: Column, path: list[str]) -> Column:
    return reduce(lambda x, name: x[name], path, c)


def compiled(e: Any, scope: Scope) -> Column:
    if isinstance(e, Column):
        return e
    if isinstance(e, str):
        return scope.variable(e[2:]) if e.startswith("$$") else scope.field(e[1:]) if e.startswith("$") else F.lit(e)
    if isinstance(e, dict):
        if len(e) == 1 and (op := next(iter(e))).startswith("$"):
            return operator(op, e[op], scope)
        return F.struct(*[compiled(v, scope).alias(k) for k, v in e.items()])
    if isinstance(e, (list, tuple)):
        return F.array(*[compiled(x, scope) for x in e])
    return F.lit(e)


def operator(op: str, arg: Any, scope: Scope) -> Column:
    if op in SPECIAL:
        return SPECIAL[op](arg, scope)
    args = [compiled(x, scope) for x in (arg if isinstance(arg, (list, tuple)) else [arg])]
    if op not in PLAIN:
        raise ValueError(f"unknown expression operator {op}")
    return PLAIN[op](*args)


def _fold(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda *args: reduce(f, args)


def _index(a: Column, i: Column) -> Column:
    """Counted from zero, from the end where negative; null beyond either."""
    return F.try_element_at(a, F.when(i < 0, i).otherwise(i + 1).cast("int"))


def _slice(a: Column, first: Column, n: Column | None = None) -> Column:
    if n is None:  # the first n, or the last where n is negative
        first, n = F.when(first < 0, F.greatest(first, -F.size(a))).otherwise(F.lit(0)), F.abs(first)
    start = F.when(first < 0, F.greatest(F.size(a) + first, F.lit(0))).otherwise(first) + 1
    return F.slice(a, start.cast("int"), n.cast("int"))


def _truncated(x: Column, places: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), places) if places is not None else F.lit(1.0)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def _rounded(x: Column, places: Column) -> Column:
    """Halves go to the even neighbour."""
    scale = F.pow(F.lit(10.0), places)
    return F.rint(x * scale) / scale


def _type(x: Column) -> Column:
    own = F.typeof(x)
    out = F.when(x.isNull(), "null")
    for name, kinds in TYPE_NAMES.items():
        out = out.when(own.isin(*kinds), name)
    return out.when(own.startswith("array"), "array").when(own.startswith("struct") | own.startswith("map"), "object").when(own.startswith("decimal"), "decimal").otherwise(own)


PLAIN: dict[str, Callable[..., Column]] = {
    "$add": _fold(lambda a, b: a + b), "$subtract": lambda a, b: a - b, "$multiply": _fold(lambda a, b: a * b), "$divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "$mod": F.try_mod,
    "$abs": F.abs, "$ceil": F.ceil, "$floor": F.floor, "$round": lambda x, n=None: _rounded(x, F.lit(0) if n is None else n), "$trunc": _truncated, "$sqrt": F.sqrt, "$pow": F.pow, "$exp": F.exp, "$ln": F.log, "$log10": F.log10,
    "$concat": F.concat, "$toLower": lambda x: F.lower(F.coalesce(x, F.lit(""))), "$toUpper": lambda x: F.upper(F.coalesce(x, F.lit(""))), "$strLenCP": F.char_length, "$split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1),
    "$substr": lambda s, at, n: F.substring(s, (at + 1).cast("int"), n.cast("int")), "$indexOfCP": lambda s, part: F.position(part, s) - 1,
    "$size": F.size, "$arrayElemAt": _index, "$slice": _slice, "$concatArrays": F.concat, "$reverseArray": F.reverse, "$isArray": lambda x: F.typeof(x).startswith("array"), "$in": lambda x, a: F.array_contains(a, x),
    "$first": lambda a: _index(a, F.lit(0)), "$last": lambda a: _index(a, F.lit(-1)), "$setUnion": _fold(F.array_union), "$setIntersection": _fold(F.array_intersect), "$setDifference": F.array_except, "$range": lambda a, b, step=None: F.filter(F.sequence(a, b, *([step] if step is not None else [])), lambda x: x < b),
    "$and": _fold(lambda a, b: a & b), "$or": _fold(lambda a, b: a | b), "$not": lambda a: ~F.coalesce(a, F.lit(False)), "$eq": lambda a, b: a.eqNullSafe(b), "$ne": lambda a, b: ~a.eqNullSafe(b), "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b,
    "$cmp": lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0), "$ifNull": F.coalesce,
    "$toString": lambda x: x.cast("string"), "$toInt": lambda x: x.try_cast("int"), "$toLong": lambda x: x.try_cast("bigint"), "$toDouble": lambda x: x.try_cast("double"), "$toDate": lambda x: x.try_cast("timestamp"), "$toBool": lambda x: x.try_cast("boolean"), "$type": _type,
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$day": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second, "$dayOfWeek": F.dayofweek, "$dayOfYear": F.dayofyear,
}
PLAIN |= {"$substrCP": PLAIN["$substr"], "$substrBytes": PLAIN["$substr"]}


def _cond(arg: Any, scope: Scope) -> Column:
    test, yes, no = (arg["if"], arg["then"], arg["else"]) if isinstance(arg, dict) else arg
    return F.when(compiled(test, scope), compiled(yes, scope)).otherwise(compiled(no, scope))


def _switch(arg: Any, scope: Scope) -> Column:
    out = None
    for branch in arg["branches"]:
        test, value = compiled(branch["case"], scope), compiled(branch["then"], scope)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(compiled(arg.get("default"), scope))


def _let(arg: Any, scope: Scope) -> Column:
    return compiled(arg["in"], scope.bind(**{k: compiled(v, scope) for k, v in arg["vars"].items()}))


def _filter(arg: Any, scope: Scope) -> Column:
    out = F.filter(compiled(arg["input"], scope), lambda x: compiled(arg["cond"], scope.bind(**{arg.get("as", "this"): x})))
    return F.slice(out, 1, arg["limit"]) if arg.get("limit") else out


def _map(arg: Any, scope: Scope) -> Column:
    return F.transform(compiled(arg["input"], scope), lambda x: compiled(arg["in"], scope.bind(**{arg.get("as", "this"): x})))


def _reduce(arg: Any, scope: Scope) -> Column:
    """The type of the result is that of the step from the first value on."""
    over, start = compiled(arg["input"], scope), compiled(arg["initialValue"], scope)
    kind = scope.kind(over)
    if isinstance(kind, T.ArrayType) and isinstance(arg["initialValue"], (int, float)) and not isinstance(arg["initialValue"], bool):
        start = start.cast("double" if isinstance(kind.elementType, T.FractionalType) or isinstance(arg["initialValue"], float) else "bigint")
    typed = scope.kind(start)
    step = lambda acc, x: compiled(arg["in"], scope.bind(value=acc, this=x))
    return F.aggregate(over, start, lambda acc, x: step(acc, x).cast(typed) if typed is not None else step(acc, x))


def _date_text(arg: Any, scope: Scope) -> Column:
    form = arg.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")
    out = ""
    at = 0
    while at < len(form):
        if form[at : at + 2] in DATE_PARTS:
            out += DATE_PARTS[form[at : at + 2]]
            at += 2
        else:
            out += "''" if form[at] == "'" else f"'{form[at]}'" if form[at].isalpha() else form[at]
            at += 1
    return F.date_format(compiled(arg["date"], scope), out)


def _trim(side: Callable[..., Column]) -> Callable[[Any, Scope], Column]:
    def run(arg: Any, scope: Scope) -> Column:
        spec = arg if isinstance(arg, dict) and "input" in arg else {"input": arg}
        text = compiled(spec["input"], scope)
        return side(text, compiled(spec["chars"], scope)) if "chars" in spec else side(text)

    return run


def _to_pairs(arg: Any, scope: Scope) -> Column:
    """{k, v} of each field of an object, values as text where their types differ."""
    c = compiled(arg, scope)
    kind = scope.kind(c)
    if isinstance(kind, T.StructType):
        alike = len({f.dataType.simpleString() for f in kind}) == 1
        return F.when(c.isNotNull(), F.array(*[F.struct(F.lit(f.name).alias("k"), (c[f.name] if alike else c[f.name].cast("string")).alias("v")) for f in kind]))
    return F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def _from_pairs(arg: Any, scope: Scope) -> Column:
    """A map of {k, v} objects or [k, v] pairs; of equal keys the last counts."""
    c = compiled(arg, scope)
    kind = scope.kind(c)
    pairs = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    keyed = F.transform(c, lambda e: F.struct((e[0] if pairs else e["k"]).alias("k"), (e[1] if pairs else e["v"]).alias("v")))
    last = F.filter(keyed, lambda e, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def _merge(arg: Any, scope: Scope) -> Column:
    """One object with the fields of all; of a field that several have, the last that isn't null."""
    parts = [compiled(x, scope) for x in (arg if isinstance(arg, (list, tuple)) else [arg])]
    names: dict[str, list[Column]] = {}
    for p in parts:
        kind = scope.kind(p)
        if isinstance(kind, T.StructType):
            for f in kind:
                names.setdefault(f.name, []).append(p[f.name])
        elif isinstance(kind, T.MapType):
            return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b), parts)
    return F.struct(*[F.coalesce(*reversed(own)).alias(n) for n, own in names.items()])


SPECIAL: dict[str, Callable[[Any, Scope], Column]] = {
    "$literal": lambda a, s: F.lit(a) if not isinstance(a, (dict, list)) else compiled(a, s), "$cond": _cond, "$switch": _switch, "$let": _let, "$filter": _filter, "$map": _map, "$reduce": _reduce, "$dateToString": _date_text,
    "$trim": _trim(F.trim), "$ltrim": _trim(F.ltrim), "$rtrim": _trim(F.rtrim), "$objectToArray": _to_pairs, "$arrayToObject": _from_pairs, "$mergeObjects": _merge,
    "$replaceAll": lambda a, s: F.replace(compiled(a["input"], s), compiled(a["find"], s), compiled(a["replacement"], s)),
    "$regexMatch": lambda a, s: F.rlike(compiled(a["input"], s), F.lit(("(?i)" if "i" in a.get("options", "") else "") + a["regex"])),
    "$anyElementTrue": lambda a, s: F.exists(compiled(a[0] if isinstance(a, list) else a, s), lambda x: x.cast("boolean")), "$allElementsTrue": lambda a, s: F.forall(compiled(a[0] if isinstance(a, list) else a, s), lambda x: x.cast("boolean")),
    "$getField": lambda a, s: compiled(a["input"], s)[a["field"]] if isinstance(a, dict) else s.field(a),
}
