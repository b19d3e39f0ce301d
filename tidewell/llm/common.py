"""Shared plumbing of the training-data operators.

Conventions every operator of this subpackage keeps:

* it selects only the columns it needs, under names of its own, so extra or clashing columns of the input are harmless;
* a null text is an empty text unless the operator says otherwise;
* Python code sees Arrow batches, cut into slices of bounded row count, and keeps nothing that grows with the input;
* intermediate tables that are read more than once are written to the folder in ``spark.checkpoint.dir``, which all
  executors share, so that a lost executor costs a recomputed task and not a lost table.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.stages import discard, scratch, staged  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
#: bytes that end a word
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Files whose names are sent to all tasks, at most.
FILES = 1 << 16
#: rows that a Python task turns into objects at once
SLICE_ROWS = 256

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; null ids fold as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: What a worker process does to give back the memory of caches that only one operator reads.
_releases: list[Callable[[], None]] = []


def keeps_cache(release: Callable[[], None]) -> None:
    """Workers serve one operator after another; ``release`` runs when this one turns to another operator's rows."""
    if release not in _releases:
        _releases.append(release)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, own_cache: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows in slices of bounded count. own_cache: the caller is the operator whose caches the worker keeps."""
    if _releases and not own_cache:
        while _releases:
            _releases.pop()()
        gc.enable()
        gc.collect()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column end to end as bytes, and the offsets at which each begins (one more than texts)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sample_by_hash(df: DataFrame, share: Column, salt: int) -> DataFrame:
    """Rows whose hashed id falls under their share: repeatable, no shuffle. df has a column ``id``."""
    unit = F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    return df.where(unit < share)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row that is the same whenever the frame is read again.

    Rows of Parquet files are numbered by file and place in it, so nothing is copied. Other frames, and such of more than ``FILES`` files, whose
    names would be too many to send to all tasks, are numbered once and staged.
    """
    files = None
    if "_metadata" not in docs.columns:
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
            files = [r[0] for r in placed.select("__file").distinct().limit(FILES + 1).collect()]
        except AnalysisException:  # not read from such files
            files = None
    if not files or len(files) > FILES:
        return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    numbers = docs.sparkSession.createDataFrame(list(enumerate(sorted(files))), "__number long, __file string")
    return placed.join(F.broadcast(numbers), "__file").withColumn(name, F.shiftleft("__number", 40) + F.col("__at")).drop("__file", "__at", "__number")
