"""Change logs as streams: reading, event-time aggregates with watermarks, and applying changes to a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, schema: str, where: Column | None = None, per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a change-log folder; the query's checkpoint is the resume token."""
    reader = spark.readStream.schema(schema)
    df = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)
    return df if where is None else df.where(where)


def windowed(df: DataFrame, time: str, size: str, keys: list[str], aggregates: list[Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time windows; rows later than ``late`` behind the newest are dropped by the watermark."""
    stamped = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(*aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], late: str = "10 minutes") -> DataFrame:
    stamped = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def distinct_within(df: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark's delay; state older than that is dropped."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def folded(df: DataFrame, keys: list[str], step: Callable[[Any, pd.DataFrame], Any], state: str, out: str, start: Any, idle: str | None = None) -> DataFrame:
    """A state for each key that ``step`` (old state, new rows) carries on, a row (keys, state) for each change; ``out`` is that row's schema.

    With ``idle``, in milliseconds, the state of a key that has no rows for so long is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else start
        for rows in batches:
            now = tuple(step(now, rows))
        held.update(now)
        if idle:
            held.setTimeoutDuration(int(idle))
        yield pd.DataFrame([[*key, *now]], columns=names)

    names = [f.split()[0] for f in out.split(",")]
    return df.groupBy(*keys).applyInPandasWithState(run, out, state, "update", "ProcessingTimeTimeout" if idle else "NoTimeout")


def apply_changes(changes: DataFrame, target: str, key: str, version: str, checkpoint: str, deleted: str = "deleted") -> StreamingQuery:
    """Folds each micro-batch into the next version of a Parquet table under ``target``/v=<batch>; a batch run twice writes the same."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max_by(F.struct("*"), version).alias("r")).select("r.*")
        live = last.where(~F.coalesce(F.col(deleted), F.lit(False)))
        if number:
            old = spark.read.parquet(f"{target}/v={number - 1}")
            live = old.join(last.select(key), key, "left_anti").unionByName(live)
        live.write.mode("overwrite").parquet(f"{target}/v={number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
