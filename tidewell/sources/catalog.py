"""Named sources: tables by name, files by format, inline rows, unions of several sources, and versioned change logs."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.sources.stages import discard, staged

FAMILIES = {"rows": "rows", "tables": "rows", "table": "rows", "row": "rows", "docs": "docs", "collections": "docs", "doc": "docs"}


def no_rules() -> dict[str, Any]:
    return {"required": [], "unique": [], "checks": {}, "references": {}, "defaults": {}}


class Catalog:
    """Resolves ``[family.]namespace.collection`` names; one part is namespace ``default``. Mounted files are opened when first asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frames: dict[tuple[str, str, str], DataFrame] = {}
        self._files: dict[str, str] = {}
        self._rules: dict[str, dict[str, Any]] = {}
        #: earlier and current versions of stored tables, by name
        self.versions: dict[str, list[DataFrame]] = {}
        self.tags: dict[tuple[str, str], int] = {}
        self._made: dict[str, list[datetime]] = {}
        self.materialised: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> None:
        key = self.split(name)
        self._frames[key] = df
        if key[1] == "default":
            df.createOrReplaceTempView(key[2])

    def mount(self, folder: str, names: list[str]) -> None:
        """Parquet tables folder/name.parquet. Timestamps without zone stay as they are."""
        self._files |= {name: f"{folder}/{name}.parquet" for name in names}

    def open_named(self, text: str) -> None:
        """Opens the mounted tables whose names occur in a statement."""
        for name in set(re.findall(r"\w+", text)) & set(self._files):
            self.put(name, self.spark.read.parquet(self._files.pop(name)))

    @staticmethod
    def split(name: str) -> tuple[str, str, str]:
        parts = name.split(".")
        family = FAMILIES[parts.pop(0).lower()] if len(parts) > 1 and parts[0].lower() in FAMILIES else None
        space = parts.pop(0) if len(parts) > 1 else "default"
        table = ".".join(parts)
        return family or ("rows" if table.startswith(("rows_", "table_", "tbl_")) else "docs"), space, table

    def _found(self, name: str) -> tuple[str, str, str] | None:
        self.open_named(name)
        family, space, table = self.split(name)
        return next(((kind, space, table) for kind in (family, "docs", "rows") if (kind, space, table) in self._frames), None)

    def known(self, name: str) -> bool:
        return self._found(name) is not None

    def resolve(self, name: str) -> DataFrame:
        key = self._found(name)
        return self._frames[key] if key else self.spark.table(name)

    def store(self, name: str, df: DataFrame, rules: dict[str, Any] | None = None) -> DataFrame:
        """The next version of a table, checked against its rules; versions before it stay."""
        from tidewell.plans.dml import enforced

        key = self._found(name)
        if name not in self.versions and key:
            self.versions[name], self._made[name] = [self._frames[key]], [datetime.min]
        after = staged(df, f"table-{name}")
        if rules is not None:
            self._rules[name] = rules
        if name in self._rules:
            enforced(self, name, after, self._rules[name])
        self.versions.setdefault(name, []).append(after)
        self._made.setdefault(name, []).append(datetime.now())
        self.put(name, after)
        return after

    def rules(self, name: str) -> dict[str, Any]:
        return self._rules.get(name) or no_rules()

    def at_version(self, name: str, version: int | str) -> DataFrame:
        """A stored table as it was: by number, from 0, or by a tag."""
        return self.versions[name][self.tags[name, version] if isinstance(version, str) else version]

    def at_time(self, name: str, when: datetime) -> DataFrame:
        """A stored table as it was at a time."""
        return self.versions[name][max(i for i, made in enumerate(self._made[name]) if made <= when)]

    def tag(self, name: str, label: str) -> None:
        self.tags[name, label] = len(self.versions[name]) - 1

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Deletes the files of all but the last versions of a stored table; returns how many versions went. Tagged versions stay."""
        every = self.versions.get(name, [])
        tagged = {v for (n, _), v in self.tags.items() if n == name}
        gone = [i for i in range(len(every) - keep) if i not in tagged and every[i] is not None]
        for i in gone:
            discard(every[i])
            every[i] = None
        return len(gone)

    def drop(self, name: str) -> bool:
        key = self._found(name)
        self.materialised.pop(name, None)
        self._rules.pop(name, None)
        if key is None:
            return False
        del self._frames[key]
        if key[1] == "default":
            self.spark.catalog.dropTempView(key[2])
        return True

    def wildcard(self, space: str | None = None, table: str | None = None) -> DataFrame:
        """All collections that match; None means every one. Columns are united by name."""
        for name in list(self._files):
            if table in (None, name) and space in (None, "default"):
                self.open_named(name)
        found = [df for (_, s, t), df in self._frames.items() if space in (None, s) and table in (None, t)]
        if not found:
            raise KeyError(f"no collection {space}.{table}")
        return union_sources(*found)


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def inline(spark: SparkSession, rows: list[dict[str, Any]], schema: str | None = None) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: Any) -> DataFrame:
    """csv (with header), json, parquet, orc, text or binaryFile."""
    reader = spark.read.format(kind).options(**({"header": True} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def save(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options: Any) -> None:
    writer = df.write.format(kind).mode(mode).options(**({"header": True} if kind == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def as_of(log: DataFrame, key: str, version: str, at: Any, deleted: str = "deleted") -> DataFrame:
    """State of a change log at a version: the last row of each key at or before it, without deleted ones."""
    last = log.where(F.col(version) <= F.lit(at)).groupBy(key).agg(F.max_by(F.struct("*"), version).alias("last"))
    return last.select("last.*").where(~F.coalesce(F.col(deleted), F.lit(False)))


def upsert(target: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """Whole rows of changes replace those of the same key; of several changes of a key the caller keeps one."""
    keys = [key] if isinstance(key, str) else list(key)
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(target: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    names = [key] if isinstance(key, str) else list(key)
    return target.join(keys.select(*names), names, "left_anti")


def add_edges(edges: DataFrame, more: DataFrame, seq: str | None = None) -> DataFrame:
    """Edges with one weight for each (src, dst): the added one, by default 1.0; of several added the one of the greatest ``seq``, or the greatest weight."""
    if "weight" not in more.columns:
        more = more.withColumn("weight", F.lit(1.0))
    last = more.groupBy("src", "dst").agg((F.max_by("weight", seq) if seq else F.max("weight")).alias("weight"))
    return upsert(edges.select("src", "dst", "weight"), last, ["src", "dst"])


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return delete(edges, gone, ["src", "dst"])


def shard_of(key: Column, shards: int) -> Column:
    """Which of so many shards a key belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def resharded(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows dealt to shards by key, in a column ``shard``; write with partition_by ("shard",) for a folder a shard."""
    return df.withColumn("shard", shard_of(F.col(key), shards)).repartition(shards, "shard")


def clustered(df: DataFrame, columns: list[str], bits: int = 10) -> DataFrame:
    """Rows sorted into files such that files can be skipped by any of the columns: by one column, or along a Z-curve over ranks of several."""
    if len(columns) == 1:
        return df.repartitionByRange(columns[0]).sortWithinPartitions(columns[0])
    edges = df.select(*[F.percentile_approx(F.xxhash64(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c).cast("double"), [i / (1 << bits) for i in range(1, 1 << bits)], 1 << (bits + 2)).alias(c) for c in columns]).first()
    z: Column = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        value = F.xxhash64(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c).cast("double")
        cuts = sorted(set(edges[c] or []))
        place = sum(((value > F.lit(x)).cast("int") for x in cuts), F.lit(0))
        for b in range(bits):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(place, b).bitwiseAND(F.lit(1)).cast("long"), b * len(columns) + k))
    return df.withColumn("_z", z).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")


def imported(spark: SparkSession, path: str, kind: str, columns: dict[str, str] | None = None, transform: dict[str, str] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None, schema: str | None = None, **options: Any) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected rows) of a batch of files: columns renamed, expressions applied, and rows whose references don't exist set apart."""
    df = load(spark, path, kind, schema, **options)
    for old, new in (columns or {}).items():
        df = df.withColumnRenamed(old, new)
    for name, e in (transform or {}).items():
        df = df.withColumn(name, F.expr(e))
    rejected = df.limit(0)
    for c, (other, key) in (references or {}).items():
        known = other.select(F.col(key).alias(c)).where(F.col(c).isNotNull()).distinct()
        rejected = rejected.unionByName(df.where(F.col(c).isNotNull()).join(known, c, "left_anti").select(*df.columns))
        df = df.where(F.col(c).isNull()).unionByName(df.join(known, c, "left_semi").select(*df.columns))
    return df, rejected


def to_arrow_file(df: DataFrame, path: str) -> None:
    """One Arrow file on the driver's machine, batch by batch; for results, not for whole corpora."""
    import pyarrow as pa

    table = df.toArrow()
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)


def from_arrow_file(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow as pa

    with pa.memory_map(path) as source:
        return spark.createDataFrame(pa.ipc.open_file(source).read_all())


def to_duckdb(df: DataFrame, name: str, connection: Any = None) -> Any:
    """A DuckDB connection that has the rows as a table; for results, as they pass through the driver."""
    import duckdb

    connection = connection or duckdb.connect()
    table = df.toArrow()
    connection.register("__rows", table)
    connection.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM __rows")
    connection.unregister("__rows")
    return connection


def from_duckdb(spark: SparkSession, connection: Any, sql: str) -> DataFrame:
    return spark.createDataFrame(connection.sql(sql).to_arrow_table())


def partitioned(df: DataFrame, column: str, ranges: dict[str, tuple[Any, Any]] | None = None, lists: dict[str, list[Any]] | None = None, hashes: int | None = None, default: str = "default", name: str = "part") -> DataFrame:
    """Rows with the name of their partition: the first range [low, high) or list that has the value, one of so many by hash, or the default. Write with partition_by (name,); several calls nest."""
    c, out = F.col(column), F.lit(None).cast("string")
    for part, (low, high) in reversed((ranges or {}).items()):
        out = F.when((F.lit(True) if low is None else c >= F.lit(low)) & (F.lit(True) if high is None else c < F.lit(high)), part).otherwise(out)
    for part, values in reversed((lists or {}).items()):
        out = F.when(c.isin(*values), part).otherwise(out)
    if hashes:
        out = F.coalesce(out, F.concat(F.lit("h"), shard_of(c, hashes).cast("string")))
    return df.withColumn(name, F.coalesce(out, F.lit(default)))


def chunked(df: DataFrame, key: str, content: str = "content", size: int = 255 * 1024) -> DataFrame:
    """key, n, data: binary contents in chunks, so that large files are rows of bounded size; empty ones have one empty chunk."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(content) / size).cast("int") - 1)
    return df.where(F.col(content).isNotNull()).select(key, F.explode(F.sequence(F.lit(0), last)).alias("n"), F.col(content).alias("_c")).select(key, "n", F.substring("_c", F.col("n") * size + 1, F.lit(size)).alias("data"))


def unchunked(chunks: DataFrame, key: str, content: str = "content") -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("n", "data")))
    return chunks.groupBy(key).agg(F.aggregate(listed, F.lit(b""), lambda a, c: F.concat(a, c["data"])).alias(content))


def tenant(df: DataFrame, name: str, column: str = "tenant") -> DataFrame:
    """One tenant's rows; write tables with partition_by (column,) so that a scan opens its folder only."""
    return df.where(F.col(column) == name)


def merge_meta(df: DataFrame, patch: dict[str, str], meta: str = "meta") -> DataFrame:
    """Map entries of patch replace or join those of the meta column."""
    fresh = F.create_map(*[F.lit(x) for kv in patch.items() for x in kv])
    return df.withColumn(meta, F.map_concat(F.map_filter(meta, lambda k, v: ~k.isin(*patch)), fresh))


def drop_meta(df: DataFrame, keys: list[str], meta: str = "meta") -> DataFrame:
    return df.withColumn(meta, F.map_filter(meta, lambda k, v: ~k.isin(*keys)))


def sequence(df: DataFrame, order: list[str], start: int = 1, step: int = 1, name: str = "seq", partition: list[str] | None = None) -> DataFrame:
    """Numbers rows in an order. Without a partition, rows are range-sorted and numbered by partition offsets, not in one task."""
    if partition:
        return df.withColumn(name, F.lit(start) + (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) * step)
    # staged, so that rows lie in the same partitions when they are counted and when they are numbered
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)), "sequence")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_before"))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.lit(start) + (F.col("_before") + F.col("_i")) * step).drop("_p", "_i", "_before")
