"""One surface over SQL, the pipeline language, document filters and graph or vector calls."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import jsons, vectors
from tidewell.operators import filters
from tidewell.plans import dml, pql
from tidewell.sources import catalog
from tidewell.sources.catalog import Catalog


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.catalog = Catalog(spark)

    def sql(self, text: str, args: dict[str, Any] | None = None) -> DataFrame:
        """Spark SQL over tables of namespace default, with ANY and ALL of subqueries, QUALIFY, JSON arrows and statements that change tables; args bind :name markers."""

        def query(own: str) -> DataFrame:
            self.catalog.open_named(own)
            own = dml.rewritten(own)
            if "jsonb_" in own:
                jsons.register(self.spark)
            return self.spark.sql(own, args=args or {})

        self.catalog.open_named(text)
        changed = dml.run(text, self.catalog, query)
        if changed is not None:
            return changed
        return dml.qualified(text, query) if re.search(r"\bQUALIFY\b", text, re.I) else query(text)

    def prepare(self, text: str) -> Callable[..., DataFrame]:
        """A query to be run with other values of its :name markers; Spark plans it for each, as literals may prune files."""
        return lambda **values: self.sql(text, values)

    def pql(self, text: str, **params: Any) -> DataFrame:
        return pql.run(text, self.catalog, params)

    def find(self, name: str, where: dict[str, Any] | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
        df = self.catalog.resolve(name).where(filters.matches(where or {}))
        return df.offset(offset).limit(limit) if limit is not None else df.offset(offset)

    def put(self, name: str, rows: DataFrame, key: str | list[str] = "_id") -> DataFrame:
        """Whole rows by key, added or replacing those there."""
        known = self.catalog.known(name)
        return self.catalog.store(name, catalog.upsert(self.catalog.resolve(name), rows, key) if known else rows)

    def update(self, name: str, where: dict[str, Any], change: dict[str, dict[str, Any]], upsert: bool = False, array_filters: list[dict[str, Any]] | None = None) -> DataFrame:
        df = self.catalog.resolve(name)
        return self.catalog.store(name, filters.upsert_where(df, where, change) if upsert else filters.update(df, where, change, array_filters))

    def delete(self, name: str, where: dict[str, Any]) -> DataFrame:
        return self.catalog.store(name, self.catalog.resolve(name).where(~filters.matches(where)))

    def put_vectors(self, name: str, rows: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
        """Vectors with their other columns, added or replacing those of the same key. The first rows fix the number of dimensions; others fail."""
        first = (self.catalog.resolve(name) if self.catalog.known(name) else rows).where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
        return self.put(name, vectors.checked(rows, first["n"], vector) if first else rows, key)

    def vector(self, name: str, value: Any, key: str = "id") -> DataFrame:
        return self.catalog.resolve(name).where(F.col(key) == F.lit(value))

    def search(self, name: str | None, query: list[float], k: int = 10, metric: str = "cosine", vector: str = "embedding", where: dict[str, Any] | None = None, meta: dict[str, str] | None = None, ids: DataFrame | None = None, key: str = "id") -> DataFrame:
        """The k nearest rows of a collection, or of all collections of a namespace ("space.*") or of all (None); filters apply before ranking, so k rows come where there are so many."""
        df = self.catalog.wildcard(None if name is None else name[:-2]) if name is None or name.endswith(".*") else self.catalog.resolve(name)
        df = df.where(F.col(vector).isNotNull()).where(filters.matches(where or {}))
        df = df.where(vectors.meta_matches(meta)) if meta else df
        df = df.join(ids.select(key).distinct(), key, "left_semi") if ids is not None else df
        return vectors.top_k(df, query, k, metric, vector)

    def aggregate(self, name: str, stages: list[dict[str, Any]]) -> DataFrame:
        return filters.aggregate(self.catalog.resolve(name), stages, self.catalog.resolve)

    def function(self, name: str, f: Any, returns: str | None = None) -> None:
        """Makes a function known to SQL and the pipeline language: SQL text of its body as ``(a INT, b INT) RETURNS INT RETURN a + b``, a pandas function or aggregate, a table function, or plain Python with its return type."""
        if isinstance(f, str):
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {f}")
        elif type(f).__name__ == "UserDefinedTableFunction":
            self.spark.udtf.register(name, f)
        else:
            self.spark.udf.register(name, f, *([returns] if returns else []))

    def within(self, seconds: float, run: Callable[[], Any]) -> Any:
        """run(), whose Spark jobs are cancelled after so many seconds; they then fail."""
        context, group = self.spark.sparkContext, uuid.uuid4().hex
        context.setJobGroup(group, "limited", interruptOnCancel=True)
        timer = threading.Timer(seconds, context.cancelJobGroup, [group])
        timer.start()
        try:
            return run()
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def stream(self, df: DataFrame, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
        """The result in Arrow batches, a partition at a time, so that the driver never holds it whole."""
        names = df.columns
        held: list[tuple] = []
        for row in df.toLocalIterator(prefetchPartitions=True):
            held.append(tuple(row))
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held])
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held])

    def explain(self, df: DataFrame, mode: str = "formatted") -> str:
        """The plan; mode ``analyze`` runs the query first, so that adaptive execution's final plan and row counts show."""
        if mode == "analyze":
            df.write.format("noop").mode("overwrite").save()
            return df._jdf.queryExecution().executedPlan().toString()
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
