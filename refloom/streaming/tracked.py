"""Progress of files whose results arrive as a stream, with a stop mark.

Rows are (file_id, at, kind, n): ``parsed`` says that a file has n references,
``result`` that one of them is done, ``stop`` that the file is cancelled.  A stop counts
from where it stands: results after it in its batch (by ``at``) and in all later batches
are not counted.  What is kept of each file is three numbers in the state store, so a
file may have any number of results and arrive in any number of batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from refloom.operators.report import progress

SCHEMA = "file_id string, at long, kind string, n long"
_STATE = "done long, total long, stopped boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileProgress(StatefulProcessor):
    """Done, total and stopped of one file."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", _STATE)

    def handleInputRows(self, key, rows, timers):
        done, total, stopped = self.file.get() if self.file.exists() else (0, 0, False)
        at, stop = [], None  # the places of this batch's results, the first stop in it
        for part in rows:
            parsed, marks = part["n"][part["kind"] == "parsed"], part["at"][part["kind"] == "stop"]
            total = max(total, int(parsed.max())) if len(parsed) else total
            stop = min([*([] if stop is None else [stop]), *([int(marks.min())] if len(marks) else [])], default=None)
            at.append(part["at"][part["kind"] == "result"].to_numpy(np.int64))
        if not stopped:
            places = np.concatenate(at)
            done += int(len(places) if stop is None else (places < stop).sum())
        stopped = bool(stopped or stop is not None)
        self.file.update((done, total, stopped))
        yield pd.DataFrame({"file_id": [key[0]], "done": [done], "total": [total], "stopped": [stopped]})

    def close(self) -> None:
        pass


def track(spark: SparkSession, source: str, target: str, checkpoint: str, *, files_per_batch: int | None = None) -> None:
    """Read what is new in ``source`` and publish the progress of the files it concerns below ``target``."""
    stream = spark.readStream.schema(SCHEMA)
    stream = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(source)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        changed = stream.groupBy("file_id").transformWithStateInPandas(FileProgress(), f"file_id string, {_STATE}", "Update", "None")
        publish = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        changed.writeStream.foreachBatch(publish).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)


def latest(spark: SparkSession, target: str) -> DataFrame:
    """(file_id, done, total, percent, stopped) as last published."""
    last = Window.partitionBy("file_id").orderBy(F.desc("batch"))
    rows = spark.read.parquet(target).withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return rows.select("file_id", "done", "total", progress(F.col("done"), F.col("total")).alias("percent"), "stopped")
