"""JSON text that is changed or tested: paths, merging, containment, keys. Built-in functions read JSON but don't write into it, so these are Arrow-batched Python functions.

A path is a list of keys and positions, written {a,b,0}. Null texts give null; texts that aren't JSON give null too. Objects keep the order of their keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_BAD = ...  # what isn't JSON; one object in every process


def _read(text: str | None) -> Any:
    if text is None:
        return _BAD
    try:
        return json.loads(text)
    except ValueError:
        return _BAD


def _write(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def path_of(text: str) -> list[str]:
    return [p.strip() for p in text.strip("{}").split(",") if p.strip()]


def _child(doc: Any, key: str) -> Any:
    if isinstance(doc, dict):
        return doc.get(key, _BAD)
    if isinstance(doc, list) and key.lstrip("-").isdigit() and -len(doc) <= int(key) < len(doc):
        return doc[int(key)]
    return _BAD


def put(doc: Any, path: list[str], value: Any, create: bool = True, insert: bool = False, after: bool = False) -> Any:
    """doc with the value at the path; insert: only a new key, or a new element of an array before or after the place."""
    if not path:
        return doc
    key, rest = path[0], path[1:]
    if isinstance(doc, dict):
        if rest:
            return doc if key not in doc else {k: put(v, rest, value, create, insert, after) if k == key else v for k, v in doc.items()}
        if key in doc:
            return doc if insert else {k: value if k == key else v for k, v in doc.items()}
        return {**doc, key: value} if create or insert else doc
    if isinstance(doc, list) and key.lstrip("-").isdigit():
        at = int(key) + (len(doc) if int(key) < 0 else 0)
        if rest:
            return [put(v, rest, value, create, insert, after) if i == at else v for i, v in enumerate(doc)]
        if insert:
            at = min(max(at + after, 0), len(doc))
            return [*doc[:at], value, *doc[at:]]
        if 0 <= at < len(doc):
            return [value if i == at else v for i, v in enumerate(doc)]
        return ([*doc, value] if at >= 0 else [value, *doc]) if create else doc
    return doc


def removed(doc: Any, path: list[str]) -> Any:
    key, rest = path[0], path[1:]
    if rest:
        child = _child(doc, key)
        return doc if child is _BAD else put(doc, [key], removed(child, rest))
    if isinstance(doc, dict):
        return {k: v for k, v in doc.items() if k != key}
    if isinstance(doc, list):
        if key.lstrip("-").isdigit():
            at = int(key) + (len(doc) if int(key) < 0 else 0)
            return [v for i, v in enumerate(doc) if i != at]
        return [v for v in doc if v != key]
    return doc


def contains(doc: Any, part: Any) -> bool:
    if isinstance(doc, dict):
        return isinstance(part, dict) and all(k in doc and contains(doc[k], v) for k, v in part.items())
    if isinstance(doc, list):
        return all(any(contains(x, p) for x in doc) for p in part) if isinstance(part, list) else any(x == part for x in doc if not isinstance(x, (dict, list)))
    return type(doc) is type(part) and doc == part or isinstance(doc, (int, float)) and isinstance(part, (int, float)) and not isinstance(doc, bool) and not isinstance(part, bool) and doc == part


def merged(doc: Any, more: Any) -> Any:
    if isinstance(doc, dict) and isinstance(more, dict):
        return {**doc, **more}
    return [*(doc if isinstance(doc, list) else [doc]), *(more if isinstance(more, list) else [more])]


def has(doc: Any, key: str) -> bool:
    return key in doc if isinstance(doc, (dict, list)) else doc == key


def _each(kind: str, f: Callable[..., Any]):
    """A column function of texts, the first of which is JSON."""

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for first, *rest in zip(*columns, strict=True):
            doc = _read(first)
            out.append(None if doc is _BAD or any(r is None for r in rest) else f(doc, *rest))
        return pd.Series(out, dtype=object)

    names = ", ".join(f"c{i}: pd.Series" for i in range(f.__code__.co_argcount))
    scope: dict[str, Any] = {"pd": pd, "run": run}
    exec(f"def typed({names}) -> pd.Series:\n    return run({', '.join(f'c{i}' for i in range(f.__code__.co_argcount))})", scope)  # noqa: S102  pandas functions are typed by their signature
    return F.pandas_udf(scope["typed"], kind)


def _put_text(doc: Any, path: str, value: str) -> str:
    new = _read(value)
    return _write(put(doc, path_of(path), value if new is _BAD else new))


def _insert_text(doc: Any, path: str, value: str) -> str:
    new = _read(value)
    return _write(put(doc, path_of(path), value if new is _BAD else new, insert=True))


FUNCTIONS = {
    "jsonb_set": ("string", _put_text),
    "jsonb_insert": ("string", _insert_text),
    "jsonb_delete": ("string", lambda doc, key: _write(removed(doc, [key]))),
    "jsonb_delete_path": ("string", lambda doc, path: _write(removed(doc, path_of(path)))),
    "jsonb_merge": ("string", lambda doc, more: None if (m := _read(more)) is _BAD else _write(merged(doc, m))),
    "jsonb_contains": ("boolean", lambda doc, part: None if (p := _read(part)) is _BAD else contains(doc, p)),
    "jsonb_exists": ("boolean", lambda doc, key: has(doc, key)),
    "jsonb_exists_any": ("boolean", lambda doc, keys: any(has(doc, k) for k in path_of(keys))),
    "jsonb_exists_all": ("boolean", lambda doc, keys: all(has(doc, k) for k in path_of(keys))),
    "jsonb_array_elements": ("array<string>", lambda doc: [_write(x) for x in doc] if isinstance(doc, list) else []),
    "jsonb_object_keys": ("array<string>", lambda doc: list(doc) if isinstance(doc, dict) else []),
    "jsonb_array_length": ("int", lambda doc: len(doc) if isinstance(doc, list) else None),
    "jsonb_typeof": ("string", lambda doc: "null" if doc is None else {"dict": "object", "list": "array", "str": "string", "int": "number", "float": "number", "bool": "boolean"}[type(doc).__name__]),
}


def column(name: str):
    """The function of that name over columns."""
    return _each(*FUNCTIONS[name])


def register(spark: SparkSession) -> None:
    """Makes all of them known to SQL."""
    for name in FUNCTIONS:
        spark.udf.register(name, column(name))
