"""Summaries of participant tables with dirty numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number


#: Participants whose work still waits for review.
PENDING = "AWAITING REVIEW"


def with_status(rows: DataFrame, status: str = PENDING, column: str = "Status") -> DataFrame:
    """Participants of one status; a null status is none."""
    return rows.where(F.col(column) == status)


def numeric_stats(rows: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """mean, sample deviation, min, max and count of what can be read as numbers, a row per column."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(F.col(c)).alias("x")) for c in columns])).alias("v")).select("v.*")
    r = lambda c, name: F.round(c, digits).alias(name)
    return long.groupBy("column").agg(r(F.avg("x"), "mean"), r(F.stddev_samp("x"), "std"), r(F.min("x"), "min"), r(F.max("x"), "max"), F.count("x").alias("count"))


def value_counts(rows: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Counts and percentages of each column's values, null among them; columns that are missing are left out."""
    there = [c for c in columns if c in rows.columns]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in there])).alias("v")).select("v.*")
    n = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("column")), digits))
