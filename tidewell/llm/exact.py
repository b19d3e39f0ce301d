"""Exact deduplication by content-defined chunk recipes.

A normalised text is cut where its own bytes say so, each chunk is given an identifier, and a text becomes its recipe,
the ordered list of its chunks' identifiers. Identifiers are verified: each distinct (digest, bytes) pair is gathered
once, and if two different chunks share a digest, all chunks are named anew with another seed until none do. Equal
recipes are then equal texts, and grouping, joining and comparing move 16 bytes a chunk and not the texts.

Chunk bytes are combined before the shuffle, so a chunk that a million copies share is moved once a task. Groups of
copies are aggregates with map-side combining, and their join back is one that adaptive execution splits where a group
is large.

Null counts as the empty text; all empty texts are equal. Of equal texts the row with the largest id stays, a null id
counts as smallest, and of rows with the same id and text one stays. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, utf8

#: Bytes of a chunk: at least, at most, and as a power of two on average beyond the least.
CHUNK_LEAST, CHUNK_MOST, CHUNK_BITS = 512, 16384, 11


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text. A cut depends on the eight bytes before it and on the cut before only."""
    n = len(text)
    if n <= CHUNK_LEAST:
        return [n] if n else []
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] << np.uint64(8 * shift) | x[shift:]
    ends = np.flatnonzero(x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CHUNK_BITS) == 0) + 8
    found, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > CHUNK_MOST:
            last += CHUNK_MOST
            found.append(last)
        if end - last >= CHUNK_LEAST or end == n and end > last:
            found.append(end)
            last = end
    return found


def chunks(text: bytes) -> list[bytes]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _named(rows: DataFrame, seed: int) -> DataFrame:
    """The distinct (digest, bytes) of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            own = list({c for t in utf8(part.column(0)) for c in chunks(t.lower())})
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(c, seed) for c in own], pa.binary()), pa.array(own, pa.binary())], names=["digest", "bytes"])

    return rows.select("text").mapInArrow(run, "digest binary, bytes binary").distinct()


def _recipes(rows: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.lower() for t in utf8(part.column(1))]  # of bytes: A-Z only
            recipe = pa.array([[xxhash.xxh3_128_digest(c, seed) for c in chunks(t)] for t in texts], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column(0), recipe, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["id", "recipe", "text_sha256"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, recipe array<binary>, text_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256, n_chunks."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seed = 0
    while not _named(rows, seed).groupBy("digest").count().where("count > 1").isEmpty():
        seed += 1
    recipes = staged(_recipes(rows, seed).withColumn("row", F.monotonically_increasing_id()), "recipes")
    groups = staged(recipes.groupBy("recipe").agg(F.max(F.struct("id", "row")).alias("stays"), F.count("*").alias("group_size")), "recipe-groups")
    return recipes.join(groups, "recipe").select(
        F.col("id").alias(id_col), F.col("stays.id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks")
    )
