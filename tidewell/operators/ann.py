"""An inverted-file index with product-quantised residuals.

Centroids and codebooks are fitted on a sample of at most ``sample`` rows, chosen by hash of the key; every row with a vector is indexed.
A search sends each query to the cells nearest to it, ranks by quantised distances and ranks the best of these again by their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.vectors import l2_squared

SAMPLE_ROWS = 20_000


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]


def _means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(points, centres).argmin(1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = points[own == j].mean(0)
    return centres


@dataclass
class Index:
    centres: np.ndarray  # cells, dimensions
    books: list[np.ndarray]  # for each part: codes, dimensions of the part
    rows: DataFrame | None = None  # key, cell, code

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)


def save(index: Index, path: str) -> None:
    """Centroids and codebooks as one table, rows as another, both under path."""
    spark = index.rows.sparkSession
    lines = [(-1, i, [float(x) for x in c]) for i, c in enumerate(index.centres)] + [(j, i, [float(x) for x in c]) for j, book in enumerate(index.books) for i, c in enumerate(book)]
    spark.createDataFrame(lines, "part int, code int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
    index.rows.write.mode("overwrite").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> Index:
    parts: dict[int, list[list[float]]] = {}
    for r in spark.read.parquet(f"{path}/books").orderBy("part", "code").collect():  # cells and codes are fixed numbers
        parts.setdefault(r["part"], []).append(r["centre"])
    return Index(np.array(parts.pop(-1)), [np.array(parts[j]) for j in sorted(parts)], spark.read.parquet(f"{path}/rows"))


def build(vectors: DataFrame, cells: int, parts: int = 16, codes: int = 256, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE_ROWS) -> Index:
    have = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    got = [r["vector"] for r in have.orderBy(F.xxhash64("key"), "key").limit(sample).collect()]  # at most sample rows
    points = np.array(got, float) if got else np.zeros((1, parts))
    centres = _means(points, min(cells, len(points)))
    index = Index(centres, [np.zeros((1, 1))] * parts)
    rest = points - centres[_nearest(points, centres).argmin(1)]
    index.books = [_means(x, min(codes, len(x))) for x in index.cut(rest)]
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # cells and codes are fixed numbers

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x, at = np.array(rows["vector"].tolist(), float), shared.value
                cell = _nearest(x, at.centres).argmin(1)
                code = np.stack([_nearest(p, b).argmin(1) for p, b in zip(at.cut(x - at.centres[cell]), at.books, strict=True)], 1).astype(np.uint8)
                yield pd.DataFrame({"key": rows["key"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in code]})

    index.rows = have.mapInPandas(coded, f"key {have.schema['key'].dataType.simpleString()}, cell int, code binary")
    return index


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int, probes: int, again: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, key, distance, rank: the k rows nearest to each row of queries, itself left out; again rows a query are ranked by their vectors."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("asked"))
    shared = vectors.sparkSession.sparkContext.broadcast(Index(index.centres, index.books))

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x = np.array(rows["asked"].tolist(), float)
                cells = np.argsort(_nearest(x, shared.value.centres), axis=1)[:, :probes]
                yield pd.DataFrame({"query": np.repeat(rows["query"].to_numpy(), cells.shape[1]), "asked": np.repeat(rows["asked"].to_numpy(), cells.shape[1]), "cell": cells.ravel().astype(np.int32)})

    def guessed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                at = shared.value
                code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
                near = at.centres[rows["cell"]] + np.concatenate([b[code[:, j]] for j, b in enumerate(at.books)], 1)
                yield pd.DataFrame({"query": rows["query"], "key": rows["key"], "guess": ((np.array(rows["asked"].tolist(), float) - near) ** 2).sum(1)})

    kind = asked.schema["query"].dataType.simpleString()
    sent = asked.mapInPandas(probed, f"query {kind}, asked array<double>, cell int")
    pairs = sent.join(index.rows, "cell").where("query != key").select("query", "asked", "key", "cell", "code")
    guesses = pairs.mapInPandas(guessed, f"query {kind}, key {kind}, guess double")
    best = guesses.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("guess", "key"))).where(F.col("rank") <= again).select("query", "key")
    exact = best.join(vectors.select(F.col(key).alias("key"), F.col(vector).alias("own")), "key").join(asked, "query").select("query", "key", F.sqrt(l2_squared(F.col("own"), F.col("asked"))).alias("distance"))
    return exact.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))).where(F.col("rank") <= k)
