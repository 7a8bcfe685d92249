"""The annotation database as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table, or a query in parentheses with an alias.

    split: (numeric column, lowest, highest, parts) reads in parallel ranges;
    rows outside the bounds go to the first and last range, none is lost.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if split:
        column, low, high, parts = split
        r = r.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return r.load()


def write_table(df: DataFrame, url: str, table: str, options: dict[str, str] | None = None, mode: str = "append") -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).mode(mode).save()
