"""Progressive publication of results and resuming, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: StructType | str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Apply ``work`` to the files not processed before and append to ``target``.

    The checkpoint remembers the files, so a second call does only new work; a
    batch that is run again replaces its own folder.
    """

    def publish(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
