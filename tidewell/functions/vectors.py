"""Vector expressions over arrays; all stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def normalize(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a)


def embedded(text: Column, dimensions: int = 64) -> Column:
    """A hashed bag of words: terms counted by signed hash in so many places, of length one. No model; equal words give equal vectors."""
    from tidewell.functions.text import index_terms

    hashes = F.transform(index_terms(text), lambda t: F.xxhash64(t))
    place = lambda i: F.filter(hashes, lambda h: F.pmod(h, F.lit(dimensions)) == i)
    sign = lambda h: F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0)
    return normalize(F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(place(i), F.lit(0.0), lambda s, h: s + sign(h))))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer: cosine in [-1, 1], dot, minus the squared L2 distance, minus the Hamming distance."""
    return {"cosine": cosine, "dot": dot, "l2": lambda x, y: -l2_squared(x, y), "hamming": lambda x, y: -hamming(x, y).cast("double")}[metric.lower()](a, b)


def quantize(a: Column, low: float, high: float) -> Column:
    """Scalar quantisation to signed bytes."""
    return F.transform(a, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor((x.cast("double") - low) / (high - low) * 255).cast("int") - 128)))


def centroid(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Element-wise mean of a vector column by group."""
    flat = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
    pairs = flat.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return pairs.select(*by, F.transform("_v", lambda p: p["_m"]).alias("centroid"))


def meta_matches(wanted: dict[str, str], meta: str = "meta") -> Column:
    """All of the entries stand in a map column. Applied before ranking, so a search still gives k rows."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(F.col(meta), F.lit(k)) == v, F.lit(False))
    return out


def checked(df: DataFrame, dimensions: int, vector: str = "embedding") -> DataFrame:
    """Rows as they are; reading one whose vector isn't of that many dimensions fails."""
    wrong = F.col(vector).isNotNull() & (F.size(vector) != dimensions)
    return df.withColumn(vector, F.when(wrong, F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size(vector).cast("string")))).otherwise(F.col(vector)))


def fused(df: DataFrame, queries: dict[str, tuple[list[float], float]], k: int = 10, metric: str = "cosine") -> DataFrame:
    """The k rows of highest weighted sum of scores over several vector columns: {column: (query, weight)}. A null vector scores 0."""
    total = F.lit(0.0)
    for column, (query, weight) in queries.items():
        total = total + weight * F.coalesce(score(metric, F.col(column), literal(query)), F.lit(0.0))
    return df.withColumn("_vector_score", total).orderBy(F.desc("_vector_score"), df.columns[0]).limit(k)


def top_k(df: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", vector: str = "embedding", threshold: float | None = None, most: float | None = None) -> DataFrame:
    """The k rows of highest score within df, filtered beforehand by whatever df filters: one scan and a top-k without a full sort. threshold and most bound the score."""
    scored = df.withColumn("_vector_score", score(metric, F.col(vector), literal(query)))
    if threshold is not None:
        scored = scored.where(F.col("_vector_score") >= threshold)
    if most is not None:
        scored = scored.where(F.col("_vector_score") <= most)
    return scored.orderBy(F.desc("_vector_score"), *[c for c in df.columns[:1]]).limit(k)
