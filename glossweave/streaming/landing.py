"""Beyond the batch plan: documents landing in a folder, outlined and segmented as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.segment import outline, segments


def landing_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, mode string", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a batch plan to each micro-batch. A batch writes its own folder, so one that is run again
    after a failure replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def outline_stream(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return run_batches(stream, outline, output, checkpoint)


def segment_stream(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return run_batches(stream, segments, output, checkpoint)
