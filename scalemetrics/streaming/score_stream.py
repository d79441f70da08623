"""Requests arriving as files, scored by the same row functions as a batch.

The work is stateless: each micro-batch is one narrow stage, so there is neither a
shuffle nor state to size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

REQUEST_SCHEMA = "respondent_id bigint, answers map<string, double>"


def read_requests(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def write_results(results: DataFrame, path: str, state: str, continuous: bool = False) -> StreamingQuery:
    """Append results; ``state`` is the checkpoint folder that makes the sink exactly-once.

    Takes what has arrived and stops, or keeps going when ``continuous``.
    """
    writer = results.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append")
    return (writer.trigger(processingTime="10 seconds") if continuous else writer.trigger(availableNow=True)).start()
