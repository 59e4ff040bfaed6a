"""The stateless projections on streams of requests or samples: beyond the reference, which has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def json_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run(source: DataFrame, projection: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a batch projection to each micro-batch and append the rows as JSON; each file is taken once."""
    query = projection(source).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (query.trigger(availableNow=True) if once else query).start()
