"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target in words: its share by weight of a total, but no more than ``cap`` times its own size, where
the excess goes to the others by weight. A source's rate, target over size, is the expected number of times that each of
its documents is taken. The whole part of the rate is taken outright; the fraction is an inclusion probability, and the
cube method turns all probabilities of a source into 0 or 1: it walks through the null space of the balancing constraints
(sum of words, number of documents), so both totals stay exact, until at most two documents remain between 0 and 1.

The walk is parallel: blocks of a source walk by themselves and leave at most two documents each, these form the blocks
of the next level, and so on until a source is one block; there the last two are rounded to the nearest total of words
(the landing problem). A hot source is just more blocks. Random numbers are hashes of ids, so reruns agree.

Null sources are a source of their own, which comes last. Texts that are null or have no word are of size 0 and never
taken. Repeated rows are documents of their own, but those of equal id and size share their random numbers. Very long texts are counted whole; an empty table
gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.catalog import sequence

from .common import WORD, staged

EPS = 1e-9


def targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From rows (source, size): source, source_size, target.

    Sources, ordered by code point with null last, take the weights in turn; they are numbered by range partitions, as there may be millions. Their targets are
    min(cap * size, level * weight) for the one level at which they sum to ``total`` times all sizes. It is found as resharing finds it: sources above their
    cap are set to it and the rest is shared anew, one aggregate a round, until none is.
    """
    own = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    own = sequence(own.withColumn("none", F.col("source").isNull()), ["none", "source"], 0, name="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    own = staged(own.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")), "sources")
    whole, level = float(own.agg(F.sum("source_size")).first()[0] or 0) * total, 0.0
    while True:
        free = F.col("most") > F.lit(level) * F.col("weight")
        r = own.agg(F.sum(F.when(free, F.col("weight"))).alias("shares"), F.sum(F.when(~free, F.col("most"))).alias("set")).first()
        if not r["shares"]:  # all are at their caps
            return own.select("source", "source_size", F.col("most").cast("double").alias("target"))
        higher = (whole - (r["set"] or 0.0)) / r["shares"]
        if higher <= level:
            return own.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).cast("double").alias("target"))
        level = higher


def flight(size: np.ndarray, pi: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase: sums of pi and of size * pi unchanged, at most two of them not 0 or 1.

    Three documents at a time have a null-space direction of the two constraints, the cross product of (1, 1, 1) and their
    sizes; two of equal size have (1, -1). One of two steps along it is drawn such that each probability keeps its mean.
    """
    pi, live, k, n = pi.astype(float).copy(), [], 0, len(pi)
    while True:
        while len(live) < 3 and k < n:
            if EPS < pi[k] < 1 - EPS:
                live.append(k)
            k += 1
        s = [size[i] for i in live]
        pair = next(((a, b) for a in range(len(live)) for b in range(a) if s[a] == s[b]), None)
        if pair is not None:
            used, d = [live[pair[0]], live[pair[1]]], [1.0, -1.0]
        elif len(live) == 3:
            used, d = live, [float(s[1] - s[2]), float(s[2] - s[0]), float(s[0] - s[1])]
        else:
            break
        up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(used, d, strict=True) if x)
        down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(used, d, strict=True) if x)
        step = up if u[used[0]] * (up + down) < down else -down
        for i, x in zip(used, d, strict=True):
            pi[i] += step * x
            if pi[i] < EPS or pi[i] > 1 - EPS:
                pi[i] = round(pi[i])
        live = [i for i in live if 0 < pi[i] < 1]
        # the numbers drawn for those that remain must be fresh ones
        for i in live:
            u[i] = (u[i] * 7919.0 + 0.61803398875) % 1.0
    return pi


def land(size: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Rounds the few that remain: the choice whose words come nearest to their expectation, first found wins."""
    left = np.flatnonzero((pi > 0) & (pi < 1))
    want, best = float((size[left] * pi[left]).sum()), None
    for bits in range(1 << len(left)):
        take = np.array([bits >> i & 1 for i in range(len(left))], float)
        off = abs(float((size[left] * take).sum()) - want)
        if best is None or off < best[0]:
            best = (off, take)
    out = pi.copy()
    out[left] = best[1]
    return out


def cube(df: DataFrame, block_rows: int = 2000) -> DataFrame:
    """df has source, id, size, pi and more; its rows with pi turned to 0 or 1, balanced within each source."""
    done, level, schema = [], 0, df.schema
    while True:
        counts = df.groupBy("source").agg(F.count("*").alias("_n"))
        stats = counts.agg(F.max("_n")).first()[0]
        last = stats is None or stats <= block_rows
        blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / block_rows)).cast("int")
        dealt = df.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_block", F.pmod(F.xxhash64(F.lit(level), "id", "size"), blocks)).withColumn("_blocks", blocks)
        dealt = dealt.withColumn("_u", F.pmod(F.xxhash64(F.lit(1000 + level), "id", "size"), F.lit(1 << 40)) / float(1 << 40))

        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["_u", "id"], kind="stable", na_position="first")
            size = rows["size"].to_numpy()
            pi = flight(size, rows["pi"].to_numpy(), rows["_u"].to_numpy().copy())
            if rows["_blocks"].iloc[0] == 1:
                pi = land(size, pi)
            return rows.assign(pi=pi)[schema.names]

        out = staged(dealt.groupBy("source", "_block").applyInPandas(walk, schema), f"cube-{level}")
        done.append(out.where("pi = 0 OR pi = 1"))
        if last:
            return reduce(DataFrame.unionByName, done)
        df, level = out.where("pi > 0 AND pi < 1"), level + 1


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, copies (times the mix takes it), taken (words it takes). ``carry``: more columns of docs to return."""
    size: Column = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    more = [F.col(c).alias(f"more_{i}") for i, c in enumerate(carry)]
    # ids as text, as pandas would turn whole numbers with a null among them into floats
    id_type = docs.schema[id_col].dataType
    sized = staged(docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *more), "sizes")
    goal = staged(targets(sized, weights, total, cap), "targets").withColumnRenamed("source", "_s")
    rated = sized.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + EPS).cast("long")).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    open_ = F.col("pi") > EPS
    settled = rated.where(~open_).withColumn("pi", F.lit(0.0))
    out = settled.unionByName(cube(rated.where(open_)))
    copies = F.col("whole") + F.col("pi").cast("long")
    return out.select(F.col("id").cast(id_type).alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"more_{i}").alias(c) for i, c in enumerate(carry)])
