"""Statements that change tables, over versioned Parquet: INSERT, UPDATE, DELETE, COPY, CREATE, ALTER, DROP, TRUNCATE, REFRESH.

A change is one query over the table's current version whose result is the next one; earlier versions stay readable. Expressions are Spark's own,
so only the frame of a statement is read here. A statement returns one row, ``rows``, with how many it changed, or what RETURNING asks for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import filters
from tidewell.sources import catalog as sources
from tidewell.sources.stages import staged

NAME = r"[A-Za-z_][\w.]*"


class StatementError(ValueError):
    pass


def pieces(text: str) -> list[tuple[int, str]]:
    """(depth of parentheses, token): words, quoted texts, and single signs; white space is a token."""
    out, depth = [], 0
    for tok in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.", text, re.S):
        if tok.startswith(("--", "/*")):
            continue
        depth -= tok in ")]"
        out.append((depth, tok))
        depth += tok in "(["
    return out


def split(text: str, sign: str = ",") -> list[str]:
    """Parts between signs outside all parentheses and quotes."""
    parts = [""]
    for depth, tok in pieces(text):
        if depth == 0 and tok == sign:
            parts.append("")
        else:
            parts[-1] += tok
    return [p.strip() for p in parts if p.strip()]


def clauses(text: str, *words: str) -> dict[str, str]:
    """The text before the first of the words, under "", and what follows each of them, outside all parentheses. A phrase is words with single spaces."""
    toks, out, now, at = pieces(text), {"": ""}, "", 0
    while at < len(toks):
        for phrase in words:
            size, k = phrase.split(" "), at
            for w in size:
                while k < len(toks) and toks[k][1].isspace():
                    k += 1
                if k >= len(toks) or toks[k][0] or toks[k][1].upper() != w:
                    break
                k += 1
            else:
                if at == 0 or not re.match(r"\w", toks[at - 1][1][-1]):
                    now, at = phrase, k
                    out[now] = ""
                    break
        else:
            out[now] += toks[at][1]
            at += 1
    return {k: v.strip() for k, v in out.items()}


def assignments(text: str) -> dict[str, str]:
    out = {}
    for one in split(text):
        name, _, value = one.partition("=")
        out[name.strip().split(".")[-1].strip("`")] = value.strip()
    return out


def run(text: str, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame | None:
    """The result of a statement that changes something; None for a query."""
    text = re.sub(r";\s*$", "", text.strip())
    for pattern, made in STATEMENTS:
        if m := re.match(pattern, text, re.I | re.S):
            return made(m, catalog, sql)
    return None


def _changed(catalog: sources.Catalog, n: int) -> DataFrame:
    return catalog.spark.range(1).select(F.lit(n).cast("long").alias("rows"))


def _answer(catalog: sources.Catalog, touched: DataFrame, returning: str | None) -> DataFrame:
    return touched.selectExpr(*split(returning)) if returning else _changed(catalog, touched.count())


def _insert(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    name, listed = m["name"], m["columns"]
    parts = clauses(m["rest"], "ON CONFLICT", "RETURNING")
    table, rules = catalog.resolve(name), catalog.rules(name)
    given = sql(parts[""])
    columns = [c.strip(" `") for c in split(listed)] if listed else table.columns[: len(given.columns)]
    if len(columns) != len(given.columns) or not set(columns) <= set(table.columns):
        raise StatementError(f"columns of {name} and of the rows don't agree")
    given = given.toDF(*columns)
    fresh = given.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in columns else F.expr(rules["defaults"].get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in table.schema])
    fresh = staged(fresh, "insert")
    if "ON CONFLICT" in parts:
        c = re.match(r"\(([^)]*)\)\s*DO\s+(NOTHING|UPDATE\s+SET\s+(.*))", parts["ON CONFLICT"], re.I | re.S)
        if not c:
            raise StatementError("ON CONFLICT (columns) DO NOTHING or DO UPDATE SET")
        keys = [k.strip() for k in c[1].split(",")]
        if fresh.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise StatementError("two of the rows have the same key")
        new = fresh.join(table.select(*keys), keys, "left_anti")
        if c[3] is None:
            after, touched = table.unionByName(new), new
        else:
            own = clauses(c[3], "WHERE")
            change = {k: re.sub(r"(?i)\bexcluded\.(\w+)", r"__new_\1", v) for k, v in assignments(own[""]).items()}
            guard = re.sub(r"(?i)\bexcluded\.(\w+)", r"__new_\1", own.get("WHERE", "true"))
            short = name.split(".")[-1]
            both = table.alias(short).join(fresh.toDF(*[f"__new_{x}" for x in fresh.columns]), reduce(lambda a, b: a & b, [F.col(f"{short}.{k}") == F.col(f"__new_{k}") for k in keys]), "left")
            hit = F.coalesce(F.col(f"__new_{keys[0]}").isNotNull() & F.expr(guard), F.lit(False))
            merged = both.select(*[(F.when(hit, F.expr(change[f.name]).cast(f.dataType)).otherwise(F.col(f"{short}.{f.name}")) if f.name in change else F.col(f"{short}.{f.name}")).alias(f.name) for f in table.schema], hit.alias("__hit"))
            merged = staged(merged, "upsert")
            after, touched = merged.drop("__hit").unionByName(new), merged.where("__hit").drop("__hit").unionByName(new)
    else:
        after, touched = table.unionByName(fresh), fresh
    touched = staged(touched, "inserted")
    catalog.store(name, after)
    return _answer(catalog, touched, parts.get("RETURNING"))


def _update(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    name, alias = m["name"], m["alias"] or m["name"].split(".")[-1]
    parts = clauses(m["rest"], "FROM", "WHERE", "RETURNING")
    table, change, cond = catalog.resolve(name), assignments(parts[""]), parts.get("WHERE", "true")
    if missing := set(change) - set(table.columns):
        raise StatementError(f"{name} has no column {sorted(missing)[0]}")
    numbered = staged(table.withColumn("__row", F.monotonically_increasing_id()).withColumn("__hit", F.lit(False)), "update")
    numbered.createOrReplaceTempView("__target")
    new = ", ".join(f"CAST({change[f.name]} AS {f.dataType.simpleString()}) AS `__set_{f.name}`" for f in table.schema if f.name in change)
    source = f", {parts['FROM']}" if "FROM" in parts else ""
    found = sql(f"SELECT {alias}.__row, {new} FROM __target AS {alias}{source} WHERE {cond}").dropDuplicates(["__row"])
    found = staged(found, "update-rows")
    after = numbered.drop("__hit").join(found.withColumn("__hit", F.lit(True)), "__row", "left")
    value = lambda c: (F.when(F.col("__hit"), F.col(f"__set_{c}")).otherwise(F.col(c)) if c in change else F.col(c)).alias(c)
    after = staged(after.select(*map(value, table.columns), F.coalesce("__hit", F.lit(False)).alias("__hit")), "updated")
    catalog.store(name, after.drop("__hit"))
    return _answer(catalog, after.where("__hit").drop("__hit"), parts.get("RETURNING"))


def _delete(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    name = m["name"]
    alias = m["alias"] or name.split(".")[-1]
    parts = clauses(m["rest"], "USING", "WHERE", "RETURNING")
    numbered = staged(catalog.resolve(name).withColumn("__row", F.monotonically_increasing_id()), "delete")
    numbered.createOrReplaceTempView("__target")
    source = f", {parts['USING']}" if "USING" in parts else ""
    gone = staged(sql(f"SELECT DISTINCT {alias}.__row FROM __target AS {alias}{source} WHERE {parts.get('WHERE', 'true')}"), "delete-rows")
    catalog.store(name, numbered.join(gone, "__row", "left_anti").drop("__row"))
    return _answer(catalog, numbered.join(gone, "__row", "left_semi").drop("__row"), parts.get("RETURNING"))


def _create_table(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    name, body = m["name"], m["body"].strip()
    if catalog.known(name):
        if m["if"]:
            return _changed(catalog, 0)
        raise StatementError(f"{name} exists")
    if body.upper().startswith("AS"):
        made = staged(sql(body[2:]), "created")
        catalog.store(name, made)
        return _changed(catalog, made.count())
    fields, rules = [], sources.no_rules()
    for one in split(re.match(r"\((.*)\)\s*$", body, re.S)[1]):
        if t := re.match(r"(?:CONSTRAINT\s+\w+\s+)?(PRIMARY\s+KEY|UNIQUE|CHECK|FOREIGN\s+KEY)\s*\((.*?)\)(?:\s*REFERENCES\s+(\S+)\s*\((\w+)\))?\s*$", one, re.I | re.S):
            kind = re.sub(r"\s+", " ", t[1].upper())
            if kind == "CHECK":
                rules["checks"][f"check_{len(rules['checks'])}"] = t[2]
            elif kind == "FOREIGN KEY":
                rules["references"][t[2].strip()] = (t[3], t[4])
            else:
                rules["unique"].append([c.strip() for c in t[2].split(",")])
                rules["required"] += rules["unique"][-1] if kind == "PRIMARY KEY" else []
            continue
        own = clauses(one, "NOT NULL", "PRIMARY KEY", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES", "NULL")
        column, kind = own[""].split(None, 1)
        column = column.strip("`\"")
        fields.append(f"`{column}` {kind}")
        if "NOT NULL" in own or "PRIMARY KEY" in own:
            rules["required"].append(column)
        if "PRIMARY KEY" in own or "UNIQUE" in own:
            rules["unique"].append([column])
        if "DEFAULT" in own:
            rules["defaults"][column] = own["DEFAULT"]
        if "CHECK" in own:
            rules["checks"][column] = own["CHECK"]
        if "REFERENCES" in own:
            other, key = re.match(r"(\S+?)\s*\((\w+)\)", own["REFERENCES"]).groups()
            rules["references"][column] = (other, key)
    catalog.store(name, catalog.spark.createDataFrame([], ", ".join(fields)), rules)
    return _changed(catalog, 0)


def _alter(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    name, df, what = m["name"], catalog.resolve(m["name"]), m["rest"].strip()
    if a := re.match(r"ADD\s+(?:COLUMN\s+)?(\w+)\s+(.*?)(?:\s+DEFAULT\s+(.*))?$", what, re.I | re.S):
        df = df.withColumn(a[1], F.expr(a[3] or "NULL").cast(a[2].strip()))
    elif a := re.match(r"DROP\s+(?:COLUMN\s+)?(\w+)", what, re.I):
        df = df.drop(a[1])
    elif a := re.match(r"RENAME\s+(?:COLUMN\s+)?(\w+)\s+TO\s+(\w+)", what, re.I):
        df = df.withColumnRenamed(a[1], a[2])
    elif a := re.match(r"ALTER\s+(?:COLUMN\s+)?(\w+)\s+(?:SET\s+DATA\s+)?TYPE\s+(.*)", what, re.I | re.S):
        df = df.withColumn(a[1], F.col(a[1]).cast(a[2].strip()))
    else:
        raise StatementError(f"ALTER TABLE can't {what}")
    catalog.store(name, df)
    return _changed(catalog, 0)


def _view(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    """A view is read anew each time; a materialised one keeps its rows until it is refreshed."""
    if m["kept"]:
        catalog.materialised[m["name"]] = m["query"]
        return _refresh(m, catalog, sql)
    catalog.put(m["name"], sql(m["query"]))
    return _changed(catalog, 0)


def _refresh(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    if m["name"] not in catalog.materialised:
        raise StatementError(f"{m['name']} is no materialised view")
    rows = staged(sql(catalog.materialised[m["name"]]), "view")
    catalog.store(m["name"], rows)
    return _changed(catalog, rows.count())


def _options(text: str | None) -> dict[str, str]:
    out = {}
    for one in split(text or ""):
        key, *value = one.split(None, 1)
        out[key.lower()] = value[0].strip("'") if value else "true"
    return out


def _copy(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    options = _options(m["options"])
    kind = options.pop("format", "csv").lower()
    kind = {"binary": "parquet", "text": "csv"}.get(kind, kind)
    options = {{"delimiter": "sep", "null": "nullValue"}.get(k, k): v for k, v in options.items()}
    if m["way"].upper() == "TO":
        rows = sql(m["what"].strip()[1:-1]) if m["what"].strip().startswith("(") else catalog.resolve(m["what"].strip())
        sources.save(rows, m["path"], kind, **({"header": "false"} | options if kind == "csv" else options))
        return _changed(catalog, rows.count())
    target = re.match(rf"({NAME})\s*(?:\(([^)]*)\))?", m["what"].strip())
    table = catalog.resolve(target[1])
    columns = [c.strip() for c in target[2].split(",")] if target[2] else table.columns
    schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in columns)
    rows = staged(sources.load(catalog.spark, m["path"], kind, schema if kind in ("csv", "json") else None, **({"header": "false"} | options if kind == "csv" else options)).select(*columns), "copied")
    catalog.store(target[1], table.unionByName(rows, allowMissingColumns=True))
    return _changed(catalog, rows.count())


def _index(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    """Files are sorted by the columns, so their minima and maxima let scans skip those that can't match."""
    catalog.store(m["name"], sources.clustered(catalog.resolve(m["name"]), [c.strip() for c in m["columns"].split(",")]))
    return _changed(catalog, 0)


def _drop(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    if not catalog.drop(m["name"]) and not m["if"]:
        raise StatementError(f"{m['name']} doesn't exist")
    return _changed(catalog, 0)


def _truncate(m: re.Match, catalog: sources.Catalog, sql: Callable[[str], DataFrame]) -> DataFrame:
    table = catalog.resolve(m["name"])
    catalog.store(m["name"], table.limit(0))
    return _changed(catalog, table.count())


STATEMENTS: list[tuple[str, Any]] = [
    (rf"INSERT\s+INTO\s+(?P<name>{NAME})\s*(?:\((?P<columns>[^()]*)\))?\s*(?P<rest>(?:VALUES|SELECT|WITH|TABLE|FROM)\b.*)", _insert),
    (rf"UPDATE\s+(?P<name>{NAME})(?:\s+(?:AS\s+)?(?P<alias>(?!SET\b)\w+))?\s+SET\s+(?P<rest>.*)", _update),
    (rf"DELETE\s+FROM\s+(?P<name>{NAME})(?:\s+(?:AS\s+)?(?P<alias>(?!WHERE\b|USING\b|RETURNING\b)\w+))?(?P<rest>.*)", _delete),
    (rf"CREATE\s+TABLE\s+(?P<if>IF\s+NOT\s+EXISTS\s+)?(?P<name>{NAME})\s*(?P<body>\(.*\)|AS\b.*)\s*$", _create_table),
    (rf"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?P<kept>MATERIALIZED\s+)?VIEW\s+(?P<name>{NAME})\s+AS\s+(?P<query>.*)", _view),
    (rf"REFRESH\s+MATERIALIZED\s+VIEW\s+(?P<name>{NAME})\s*$", _refresh),
    (rf"ALTER\s+TABLE\s+(?P<name>{NAME})\s+(?P<rest>.*)", _alter),
    (rf"CREATE\s+INDEX\s+(?:\w+\s+)?ON\s+(?P<name>{NAME})\s*\((?P<columns>[^)]*)\)", _index),
    (rf"DROP\s+(?:TABLE|(?:MATERIALIZED\s+)?VIEW)\s+(?P<if>IF\s+EXISTS\s+)?(?P<name>{NAME})", _drop),
    (rf"TRUNCATE\s+(?:TABLE\s+)?(?P<name>{NAME})", _truncate),
    (r"COPY\s+(?P<what>\(.*\)|\S+(?:\s*\([^)]*\))?)\s+(?P<way>FROM|TO)\s+'(?P<path>[^']*)'(?:\s+(?:WITH\s*)?\((?P<options>.*)\))?\s*$", _copy),
]


def rewritten(text: str) -> str:
    """Spellings that Spark's SQL lacks: comparisons with ANY and ALL of a subquery, rows equal to a subquery, JSON arrows and tests.

    Null elements of a subquery compared by ANY or ALL don't count.
    """
    sub = r"\(\s*((?:SELECT|WITH)\b(?:[^()']|'[^']*'|\((?:[^()']|'[^']*'|\([^()]*\))*\))*)\)"

    def quantified(m: re.Match) -> str:
        left, op, which, query = m[1], m[2], m[3].upper(), m[4]
        if op == "=" and which != "ALL":
            return f"{left} IN ({query})"
        if op in ("<>", "!=") and which == "ALL":
            return f"{left} NOT IN ({query})"
        if op in ("=", "<>", "!="):
            raise StatementError(f"{op} {which} isn't supported")
        end = ("max" if op[0] == ">" else "min") if which == "ALL" else ("min" if op[0] == ">" else "max")
        return f"coalesce({left} {op} (SELECT {end}(__x) FROM ({query}) AS __s(__x)), {'true' if which == 'ALL' else 'false'})"

    text = re.sub(rf"([\w.]+)\s*(=|<>|!=|<=|>=|<|>)\s*\b(ANY|SOME|ALL)\s*{sub}", quantified, text, flags=re.I | re.S)
    text = re.sub(r"(\([^()]*,[^()]*\))\s*=\s*(\(\s*SELECT\b)", r"\1 IN \2", text, flags=re.I)
    value = r"('(?:[^']|'')*')"

    def arrows(m: re.Match) -> str:
        path = "$"
        for op, key in re.findall(rf"(->>|->|#>>|#>)\s*({value[1:-1]}|\d+)", m[2]):
            for part in key.strip("'").strip("{}").split(",") if op[0] == "#" else [key.strip("'")]:
                path += f"[{part.strip()}]" if part.strip().isdigit() else f".{part.strip()}"
        return f"get_json_object({m[1]}, '{path}')"

    text = re.sub(rf"([A-Za-z_][\w.]*)((?:\s*(?:->>|->|#>>|#>)\s*(?:{value[1:-1]}|\d+))*\s*(?:->>|#>>|#>|->(?=\s*'))\s*(?:{value[1:-1]}|\d+))", arrows, text)
    for sign, name in (("@>", "jsonb_contains({0}, {1})"), ("<@", "jsonb_contains({1}, {0})"), (r"\?\|", "jsonb_exists_any({0}, {1})"), (r"\?&", "jsonb_exists_all({0}, {1})"), (r"\?", "jsonb_exists({0}, {1})"), (r"#-", "jsonb_delete_path({0}, {1})")):
        text = re.sub(rf"([A-Za-z_][\w.]*)\s*{sign}\s*{value}", lambda m, name=name: name.format(m[1], m[2]), text)
    return text


def qualified(text: str, sql: Callable[[str], DataFrame]) -> DataFrame:
    """QUALIFY: rows of a query whose window expressions meet a condition."""
    parts = clauses(text, "QUALIFY")
    if "QUALIFY" not in parts:
        return sql(text)
    tail = clauses(parts["QUALIFY"], "ORDER BY", "LIMIT")
    head = clauses(parts[""], "FROM")
    out = sql(f"{head['']}, ({tail['']}) AS __qualified FROM {head['FROM']}").where("__qualified").drop("__qualified")
    if "ORDER BY" in tail:
        keys = [k.split() for k in split(tail["ORDER BY"])]
        out = out.orderBy(*[F.desc(k[0]) if k[-1].upper() == "DESC" else F.asc(k[0]) for k in keys])
    return out.limit(int(tail["LIMIT"])) if "LIMIT" in tail else out


def enforced(catalog: sources.Catalog, name: str, df: DataFrame, rules: dict[str, Any]) -> None:
    """Raises where rows break the table's rules, naming one of them."""
    key = df.columns[0]
    found = filters.violations(df, key, tuple(rules["required"]), (), None, rules["checks"], {c: (catalog.resolve(t), k) for c, (t, k) in rules["references"].items()}) if rules["required"] or rules["checks"] or rules["references"] else None
    first = found.limit(1).collect() if found is not None else []
    for columns in rules["unique"]:
        own: Column = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        first += df.where(own).groupBy(*columns).count().where("count > 1").limit(1).select(F.col(columns[0]).cast("string").alias("key"), F.lit(f"unique:{','.join(columns)}").alias("rule")).collect()
    if first:
        raise StatementError(f"{name} breaks {first[0]['rule']} at {first[0]['key']}")
