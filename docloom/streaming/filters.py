"""The stages are row operations, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.base import FilterStage


def filtered(stream: DataFrame, stages: list[FilterStage]) -> DataFrame:
    for stage in stages:
        stream = stage.annotate(stream).where(~F.col("removed")).drop("removed")
    return stream


def filter_files(spark: SparkSession, source: str, schema: StructType, stages: list[FilterStage], output: str, checkpoint: str) -> StreamingQuery:
    """Filters Parquet files as they arrive; takes what is there and ends."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = filtered(stream, stages).drop("filter_value").writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(output)
