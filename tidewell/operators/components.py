"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round links nodes to the least neighbour they know of, so components become stars in about log(n) rounds. A round is
two aggregates with map-side combining and two joins that adaptive execution splits at hub nodes; its result is written
to the shared folder, so lineage stays short and executors may be lost, and what the round before wrote is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.stages import discard, scratch, staged


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """node, component (its least node) for each node of an edge between two different nodes. Direction, repeats, loops and nulls don't matter."""
    with scratch() as own:
        e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
        e = staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        mark = None
        for _ in range(max_rounds):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
            large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large-star")
            discard(e, least)
            least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "small")
            small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
            discard(large, least)
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == mark:
                break
            mark = now
        else:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        own.keep(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
