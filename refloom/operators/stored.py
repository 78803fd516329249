"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder of our own only on a local master without it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="refloom-")
        sc.setCheckpointDir(found)
    return found


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """Within ``with``, tables that ``stored`` writes are deleted at the end, but for those kept.

    What is kept must not read from the others any more, that is, be stored itself.
    """

    def __enter__(self) -> Scratch:
        self.paths: dict[str, SparkSession] = {}
        self.token = _scratch.set(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = df._stored_path
        outer = self.token.old_value
        if isinstance(outer, Scratch):
            outer.paths[path] = self.paths[path]  # it is the outer one's to delete
        del self.paths[path]
        return df

    def __exit__(self, *error) -> None:
        _scratch.reset(self.token)
        for path, spark in self.paths.items():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a scan: what is built on it is planned and run from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    scratch = _scratch.get()
    if scratch is not None:
        scratch.paths[path] = df.sparkSession
    return out
