"""The daily roll-up as a stream. A record counts for the day it started, however late it comes: no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import monitor

RECORDS = "id string, kind string, repository string, start_ms long, end_ms long, status string, detailed boolean"


def source(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RECORDS).parquet(folder)


def daily(records: DataFrame) -> DataFrame:
    """The batch roll-up, over a stream; the state is one row for each day, kind and repository."""
    return monitor.daily(records)


def start(records: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    out = daily(records).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
