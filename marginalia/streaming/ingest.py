"""Raw parts that arrive as files, decoded and cut into sections as they come.

Decoding and cutting look at one paper at a time, so they need no state; the
label rules need all headers of a paper, which its row holds, but use windows,
so they run inside each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.sections import classify
from ..sources.files import decode_annotations


def classify_stream(spark: SparkSession, source: str, schema: StructType | str, out: str, checkpoint: str) -> StreamingQuery:
    """Classified sections of every new NDJSON file, appended to ``out``; runs once over what is there.

    A micro-batch that is tried again overwrites its own folder, so nothing is doubled.
    """

    def batch(df: DataFrame, n: int) -> None:
        classify(decode_annotations(df)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
