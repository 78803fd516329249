"""Tables that are merged by key: results of a run replace those of earlier runs under the same key.

Rows live in buckets by a hash of the key.  A merge rewrites only the buckets that it
touches, into a folder of its own, and then publishes a manifest that says where each
bucket now lies.  Manifests are numbered; publishing is one rename that fails if the
number is taken, so readers see the table before or after a merge and nothing between,
and of two merges at once one fails.  A merge carries the name of its run: a run that is
already in the manifest changes nothing, so retries are safe.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another merge has published meanwhile."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _text(spark: SparkSession, path: str) -> str:
    files, place = _files(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def manifest(spark: SparkSession, table: str) -> dict:
    """The newest manifest: version, runs, bucket -> folder, schema."""
    files, place = _files(spark, f"{table}/manifests")
    numbers = [int(x.getPath().getName()) for x in files.listStatus(place) if x.getPath().getName().isdigit()] if files.exists(place) else []
    return json.loads(_text(spark, f"{table}/manifests/{max(numbers):012d}")) if numbers else {"version": 0, "runs": [], "buckets": {}, "schema": None}


def _publish(spark: SparkSession, table: str, state: dict) -> None:
    files, temporary = _files(spark, f"{table}/manifests/_{uuid.uuid4().hex}")
    _, final = _files(spark, f"{table}/manifests/{state['version']:012d}")
    stream = files.create(temporary, False)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if files.exists(final) or not files.rename(temporary, final):
        files.delete(temporary, False)
        raise Conflict(f"version {state['version']} is there already")


def read(spark: SparkSession, table: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The table as of its newest manifest (or some buckets of it); None if there is none."""
    state = manifest(spark, table)
    wanted = [f"{folder}/bucket={b}" for b, folder in state["buckets"].items() if buckets is None or int(b) in buckets]
    if state["schema"] is None or (buckets is not None and not wanted):
        return None
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(state["schema"])
    return spark.read.schema(schema).parquet(*[f"{table}/{w}" for w in wanted]) if wanted else spark.createDataFrame([], schema)


def merge(rows: DataFrame, table: str, keys: list[str], order: str, *, run: str | None = None) -> int:
    """Replace the rows of the same keys and add the others; of rows with one key the last by ``order`` stays.  The new version."""
    spark = rows.sparkSession
    state = manifest(spark, table)
    if run is not None and run in state["runs"]:
        return state["version"]
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc(F.xxhash64(*rows.columns)))
    fresh = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # BUCKETS at most
    folder = f"data/{state['version'] + 1:012d}-{uuid.uuid4().hex}"
    old = read(spark, table, touched)
    if old is not None:
        same = [old[k].eqNullSafe(fresh[k]) for k in keys]
        fresh = old.join(fresh.select(*keys), same, "left_anti").unionByName(fresh)
    fresh.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{table}/{folder}")
    runs = [*state["runs"], run] if run is not None else state["runs"]
    buckets = state["buckets"] | {str(b): folder for b in touched}
    _publish(spark, table, {"version": state["version"] + 1, "runs": runs, "buckets": buckets, "schema": state["schema"] or rows.schema.jsonValue()})
    return state["version"] + 1
