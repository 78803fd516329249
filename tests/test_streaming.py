"""Only new files are processed, once."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.streaming import tracked
from refloom.streaming.progress import process_new


def test_a_second_call_does_only_new_work(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: process_new(spark, source, "id long", lambda b: b.withColumn("double", F.col("id") * 2), target, checkpoint)
    spark.range(3).write.parquet(source)
    run()
    spark.range(3, 5).write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.id, r.double) for r in spark.read.parquet(target).collect()) == [(i, 2 * i) for i in range(5)]


def test_progress_of_files_with_a_stop_mark(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(*rows):
        spark.createDataFrame(rows, tracked.SCHEMA).write.mode("append").parquet(source)
        tracked.track(spark, source, target, checkpoint)
        return {r.file_id: tuple(r)[1:] for r in tracked.latest(spark, target).collect()}

    got = run(("a", 0, "parsed", 4), ("a", 1, "result", None), ("a", 2, "result", None), ("b", 0, "parsed", 2), ("b", 1, "result", None), ("c", 0, "parsed", 0))
    assert got == {"a": (2, 4, 50, False), "b": (1, 2, 50, False), "c": (0, 0, 0, False)}
    got = run(("a", 4, "result", None), ("a", 3, "stop", None), ("b", 2, "result", None))
    assert got == {"a": (2, 4, 50, True), "b": (2, 2, 100, False), "c": (0, 0, 0, False)}
    got = run(("a", 1, "result", None), ("a", 5, "parsed", 5))
    assert got["a"] == (2, 5, 40, True)
