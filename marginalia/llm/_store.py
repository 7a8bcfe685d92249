"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs in this one process (tests, local
    runs) a folder of our own is set; on a cluster it must be configured.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"marginalia-checkpoints-{os.getuid()}")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


_made: list[Kept] = []


@contextmanager
def only() -> Iterator[list[Kept]]:
    """Tables written inside go at the end, but for those put into the list."""
    begin, stay = len(_made), []
    yield stay
    for x in [x for x in _made[begin:] if x not in stay]:
        x.drop()


def clean() -> None:
    """Deletes all tables that this process has written and not deleted; results not yet read are lost."""
    for x in list(_made):
        x.drop()


class Kept:
    """A materialised DataFrame: ``df`` reads the table, ``drop`` deletes it.

    by: a string column; each of its values is a folder of its own, which
    ``drop`` can delete by itself.
    """

    def __init__(self, df: DataFrame, what: str, by: str | None = None):
        self.spark, self.by = df.sparkSession, by
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _made.append(self)

    def part(self, value: str) -> DataFrame:
        """The rows with this value of ``by``, without that column."""
        schema = StructType([f for f in self.df.schema if f.name != self.by])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.by}={value}") if self._at(f"{self.path}/{self.by}={value}", "exists") else self.spark.createDataFrame([], schema)

    def drop(self, value: str | None = None) -> None:
        self._at(self.path if value is None else f"{self.path}/{self.by}={value}", "delete", True)
        if value is None and self in _made:
            _made.remove(self)

    def _at(self, where: str, do: str, *more: object):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return getattr(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), do)(path, *more)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now.

    It deletes them once the driver has collected the plans that used them as
    garbage, which may be long after the step on a driver with a large heap.
    """
    gc.collect()
    spark._jvm.System.gc()
