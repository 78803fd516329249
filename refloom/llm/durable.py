"""Tables that survive the loss of an executor.

``durable`` writes a DataFrame as Parquet below the session's checkpoint folder
and reads it back: the lineage ends there and every executor can read it again.
What was shuffled to write it can then go at once (``TIDY``) instead of when the
driver happens to collect its garbage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only on a local master without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="refloom-"))
    return sc.getCheckpointDir()


#: Of queries whose shuffle files go as they end; of those whose rows are so large that Python gets them one at a time.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
LARGE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries run within have these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable(df: DataFrame, name: str, conf: dict[str, str] | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder, under settings and with so many rows a file (0: any), and return it as a scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, conf or {}):
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
