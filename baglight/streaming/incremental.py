"""Growing folders, worked off in steps.

A run takes the files that came since the last one, in batches, and ends; what was read is kept in
the checkpoint of the stream, so a run that broke off is taken up where it stood and no row is
written twice: each batch has a folder of its own, which a repeated batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: StructType, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Runs an operator over the Parquet files that are new in source; its rows go below target, a folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
