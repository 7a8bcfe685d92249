"""Exact order statistics and cumulative counts without bringing all values together.

Values are counted per distinct value, and put into ``BINS`` bins of equal width
between the least and the largest; what is ordered in one place is the bins, and
the distinct values of one bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

BINS = 4096


def cumulative(values: DataFrame, column: str) -> DataFrame:
    """(v, n, upto, total): each distinct value, its count, the count up to it, and that of all; nulls are left out."""
    v = F.col(column)
    counted = stored(values.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")))  # used three times
    span = counted.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    place = F.try_divide((F.col("v") - F.col("low")).cast("double"), (F.col("high") - F.col("low")).cast("double"))
    binned = counted.join(F.broadcast(span)).withColumn("bin", F.coalesce(F.least(F.floor(place * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    ahead = binned.groupBy("bin").agg(F.sum("n").alias("m")).select("bin", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    upto = F.sum("n").over(Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return binned.join(F.broadcast(ahead), "bin").select("v", "n", (F.col("ahead") + upto).alias("upto"), "total")


def nearest(values: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """One row with q0, q1, ...: the value at rank round(p * (n - 1)) of the sorted column."""
    picks = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1) + 0.5), F.col("v"))).alias(f"q{i}") for i, p in enumerate(at)]
    return cumulative(values, column).agg(*picks)


def linear(values: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """One row with q, an array: the values at ranks p * (n - 1), interpolated between neighbours; null if there are none."""

    def pick(p: float, i: int) -> list[Column]:
        rank = F.lit(p) * (F.col("total") - 1)
        return [F.min(F.when(F.col("upto") > f(rank), F.col("v"))).alias(f"{x}{i}") for f, x in ((F.floor, "a"), (F.ceil, "b"))]

    row = cumulative(values, column).agg(F.max("total").alias("total"), *[c for i, p in enumerate(at) for c in pick(p, i)])
    part = [F.lit(p) * (F.col("total") - 1) - F.floor(F.lit(p) * (F.col("total") - 1)) for p in at]
    q = F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * x for i, x in enumerate(part)])
    return row.select(F.when(F.col("total").isNotNull(), q).alias("q"))
