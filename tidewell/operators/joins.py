"""Joins and window frames that Spark has no operator for."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cell(df: DataFrame, name: str, width: float) -> Column:
    """The number of the stretch of ``width`` that a number, or of so many seconds that a time, falls into."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        c = F.unix_micros(c.cast("timestamp")) / 1e6
    return F.floor(c / width).cast("long")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str], suffix: str = "", width: float | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of the same ``by`` at or before its ``on``.

    Both sides are united and sorted once by key and time; no pair of rows is ever formed. Of right rows of equal time the one with the greatest taken values counts.
    ``width`` (in units of ``on``, seconds for times) deals each key over stretches of that width, so that a hot key is many tasks: a stretch that has no
    right row before a left one takes the last value of the stretches before it, one row a stretch.
    """
    values = F.struct(*[F.col(c).alias(f"{c}{suffix}") for c in take])
    kind = right.select(values.alias("v")).schema["v"].dataType
    cell = (lambda df: _cell(df, on, width)) if width else (lambda df: F.lit(0).cast("long"))
    a = left.select(*by, on, cell(left).alias("_cell"), F.struct("*").alias("_row"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_val"))
    b = right.select(*by, on, cell(right).alias("_cell"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side"), values.alias("_val"))
    w = Window.partitionBy(*by, "_cell").orderBy(on, "_side", F.col("_val").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_val", F.last("_val", ignorenulls=True).over(w)).where("_side = 1")
    if width:
        ends = b.groupBy(*by, "_cell").agg(F.max_by("_val", F.struct(on, "_val")).alias("_end"))
        asked = a.select(*by, "_cell").distinct().withColumn("_end", F.lit(None).cast(kind))
        steps = ends.unionByName(asked).groupBy(*by, "_cell").agg(F.max("_end").alias("_end"))
        carried = steps.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).drop("_end").where("_carried IS NOT NULL")
        both = both.join(carried, [*by, "_cell"], "left").withColumn("_val", F.coalesce("_val", "_carried"))
    return both.select("_row.*", *[F.col("_val")[f"{c}{suffix}"].alias(f"{c}{suffix}") for c in take])


def interval_join(points: DataFrame, spans: DataFrame, at: str, since: str, until: str, width: int, by: list[str] | None = None, fan: int = 16) -> DataFrame:
    """Points within [since, until): an equi-join on buckets and a residual filter, instead of comparing all pairs.

    A span lies in buckets of ``width``, or of fan, fan * fan ... times that, such that it covers at most about ``fan`` of them, however wide it is.
    """
    steps = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.lit(1.0), (F.col(until) - F.col(since)) / (width * fan))) / log(fan))).cast("int")
    s = spans.where(F.col(until) > F.col(since)).withColumn("_level", steps)
    levels = [r["_level"] for r in s.select("_level").distinct().collect()]  # as many as the widest span has powers of fan
    size = F.pow(F.lit(float(fan)), F.col("_level")) * width
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_cell", F.floor(F.col(at) / size).cast("long"))
    s = s.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(since) / size).cast("long"), F.floor((F.col(until) - 1) / size).cast("long"))))
    return p.join(s, [*(by or []), "_level", "_cell"]).where((F.col(at) >= F.col(since)) & (F.col(at) < F.col(until))).drop("_cell", "_level")


def groups_frame(df: DataFrame, agg: Column, partition: list[str], order: str, before: int, after: int, name: str) -> DataFrame:
    """agg over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: peer groups are numbered, then a range frame runs over the numbers."""
    numbered = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return numbered.withColumn(name, agg.over(Window.partitionBy(*partition).orderBy("_g").rangeBetween(-before, after))).drop("_g")


def sum_excluding(df: DataFrame, value: str, partition: list[str], order: str, exclude: str, name: str) -> DataFrame:
    """Sum of a partition with EXCLUDE CURRENT ROW, GROUP or TIES."""
    whole, peers = Window.partitionBy(*partition), Window.partitionBy(*partition, order)
    total, own, group = F.sum(value).over(whole), F.coalesce(F.col(value), F.lit(0)), F.coalesce(F.sum(value).over(peers), F.lit(0))
    return df.withColumn(name, {"current row": total - own, "group": total - group, "ties": total - group + own, "no others": total}[exclude.lower()])


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
