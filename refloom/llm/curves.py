"""Approximate nearest neighbours by inner product on shifted Hilbert curves.

Vectors are scaled into the unit ball and lifted onto the sphere by one more
coordinate, so that the largest inner product is the nearest direction.  Each of
``CURVES`` curves projects them on ``AXES`` random orthogonal directions of its own,
spreads each projection evenly over ``BITS`` bits, adds a shift of its own and orders
the vectors by their key on the Hilbert curve.

1. equal vectors are one point with its smallest ids, counted over salted parts;
2. Spark range-partitions all points by curve and key; their place in that order is
   their position;
3. the window is measured: a bounded sample of queries is searched among all vectors
   and the window is how far one has to look, on the best of the curves, to meet the
   share ``AIM`` of their true neighbours (``LEAST`` positions at least);
4. queries meet the points of their window in tiles of bounded size, any number of
   tiles to a window; exact scores on the original vectors rank what the curves found.

Only the projections' means and deviations and the width of the window come from
samples (``FIT`` vectors and ``TRIES`` queries of each length); every vector is
indexed.  Where vectors have a structure of few dimensions windows stay short; vectors
spread evenly over many dimensions have no near neighbours to speak of, and the
measured window is then a share of the table.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do null ids; vectors only meet vectors of their length; a candidate
with the query's id is the query's own; repeated query rows (of one id and vector) are
one query, and rows of one id with different vectors are searched each and merged
under the id; repeated candidates each count; ties go to the smaller id; fewer than k
candidates give all; empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.durable import durable

CURVES = 16
AXES = 8
BITS = 5
#: Share of true neighbours that the measured window holds, its least width, sampled vectors and queries of each length.
AIM = 0.96
LEAST = 1024
FIT = 1024
TRIES = 256
#: Numbers in a tile's vectors; parts that equal vectors are first counted in.
TILE_VALUES = 1 << 18
SALTS = 32

_I = np.int64


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys on the Hilbert curve of integer points (n x dimensions, ``bits`` each)."""
    axes = [cells[:, i].astype(_I) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):  # from the coarsest cube: undo its mirroring or swapping of axes
        bit, below = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            upper = (axis & bit) > 0
            swap = np.where(upper, 0, (axes[0] ^ axis) & below)
            axes[0] = np.where(upper, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):  # Gray code over the axes
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), _I)
    for level in range(bits - 1, 0, -1):
        flip = np.where((axes[-1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    key = np.zeros(len(cells), _I)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> level) & 1)
    return key


def _directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dim + 1 x all axes) of all curves and the curves' shifts, fixed by the length."""
    rng = np.random.default_rng([12, dim])
    need, width = CURVES * AXES, dim + 1
    turns = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-need // width))] if width <= 4096 else [rng.normal(size=(width, need)) / np.sqrt(width)]
    return np.concatenate(turns, axis=1)[:, :need], rng.uniform(0, 0.5, need)


def _lifted(rows: np.ndarray, most: float, asked: np.ndarray) -> np.ndarray:
    """Points on the sphere: queries by their direction, others by vector / ``most``."""
    size = np.linalg.norm(rows, axis=1)
    by = np.where(asked, size, most)
    with np.errstate(all="ignore"):
        flat = np.nan_to_num(rows / by[:, None])
        rest = np.nan_to_num(np.sqrt(np.maximum(0.0, 1.0 - np.square(size / by))))
    return np.concatenate([flat, rest[:, None]], axis=1)


def _matrix(lists: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten(), np.float64).reshape(n, -1)


def _keys(fits: dict[int, tuple[float, np.ndarray, np.ndarray]], schema: pa.Schema):
    """One row for each point and curve, with its key."""

    def run(batches):
        known: dict = {}
        for batch in batches:
            dims = np.asarray(batch["dim"], _I)
            for dim in np.unique(dims):
                if dim not in known:
                    known[dim] = _directions(int(dim))
                axes, shift = known[dim]
                most, middle, spread = fits[int(dim)]
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                points = _lifted(_matrix(some["v"], some.num_rows), most, np.asarray(some["kind"]) == 1) @ axes
                even = 1.0 / (1.0 + np.exp(np.clip(-1.702 * (points - middle) / spread, -60, 60)))
                cells = np.minimum((even * 0.5 + shift) * (1 << BITS), (1 << BITS) - 1).astype(_I)
                for c in range(CURVES):
                    key = hilbert(cells[:, c * AXES : (c + 1) * AXES], BITS)
                    own = {"curve": pa.array(np.full(len(key), c, np.int32)), "key": pa.array(key)}
                    yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else some[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _scan(samples: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """The sampled queries among all points of a partition: the k best of each."""

    def run(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            dims = np.asarray(batch["dim"], _I)
            for dim in (int(d) for d in np.unique(dims) if int(d) in samples):
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                ids, _, queries = samples[dim]
                scores = queries @ _matrix(some["v"], some.num_rows).T
                first, h = np.asarray(some["first"], _I), np.asarray(some["h"], _I)
                scores[(ids[:, None] == first) & (np.asarray(some["many"]) == 1)] = -np.inf
                old = best.get(dim, (np.zeros((len(ids), 0)), np.zeros((len(ids), 0), _I), np.zeros((len(ids), 0), _I)))
                both = np.concatenate([old[0], scores], axis=1)
                names = [np.concatenate([o, np.broadcast_to(x, scores.shape)], axis=1) for o, x in zip(old[1:], (first, h), strict=True)]
                top = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best[dim] = (np.take_along_axis(both, top, 1), *[np.take_along_axis(x, top, 1) for x in names])
        for dim, (scores, first, h) in best.items():
            ids, own, _ = samples[dim]
            real = np.isfinite(scores)
            wide = lambda x: np.broadcast_to(x[:, None], scores.shape)[real]  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({"dim": np.full(real.sum(), dim), "query_id": wide(ids), "query_h": wide(own), "first": first[real], "h": h[real], "score": scores[real]})

    return run


_FOUND = "query_id long, query_h long, first long, h long, ids array<long>, score double"


def _tile(k: int):
    """The queries of a tile among its points: the best k of each within the window, scored exactly."""

    def run(key, table):
        kind = np.asarray(table["kind"])
        parts = []
        rows, asked = (table.take(pa.array(np.flatnonzero(kind == x))) for x in (0, 1))
        n = rows.num_rows
        if n and asked.num_rows:
            vectors, queries = _matrix(rows["v"], n), _matrix(asked["v"], asked.num_rows)
            pos, first, alone = np.asarray(rows["pos"], _I), np.asarray(rows["first"], _I), np.asarray(rows["many"]) == 1
            at, own, own_h = np.asarray(asked["pos"], _I), np.asarray(asked["first"], _I), np.asarray(asked["h"], _I)
            window, h = int(rows["window"][0].as_py()), np.asarray(rows["h"], _I)
            for s in range(0, len(at), 256):
                q = slice(s, s + 256)
                scores = queries[q] @ vectors.T
                out = (np.abs(at[q, None] - pos) > window) | ((own[q, None] == first) & alone)
                scores[out] = -np.inf
                take = min(n, k + 8)  # a few more, as products by blocks differ in the last digit
                some = np.argpartition(-scores, take - 1, axis=1)[:, :take]
                real = np.take_along_axis(~out, some, 1)
                exact = np.cumsum(queries[q][:, None, :] * vectors[some], axis=2)[:, :, -1]
                exact[~real] = -np.inf
                order = np.lexsort((first[some], -exact), axis=1)[:, :k]
                some, exact, real = (np.take_along_axis(x, order, 1) for x in (some, exact, real))
                wide = lambda x: np.broadcast_to(x[q, None], some.shape)[real]  # noqa: E731, B023
                flat = some[real]
                parts.append(pa.table({"query_id": wide(own), "query_h": wide(own_h), "first": first[flat], "h": h[flat], "ids": rows["ids"].take(pa.array(flat)), "score": exact[real]}))
        if parts:
            return pa.concat_tables(parts)
        return pa.table({"query_id": pa.array([], pa.int64()), "query_h": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})

    return run


def usable(vector: Column) -> Column:
    """The vector is there, finite and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _points(vectors: DataFrame, k: int) -> DataFrame:
    """One row for each different vector, with its k + 1 smallest ids; hot vectors are counted in salted parts first."""
    salted = Window.partitionBy("dim", "h", "v", "salt").orderBy("id")
    whole = Window.partitionBy("dim", "h", "v").orderBy("id")
    some = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k + 1)
    some = some.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= k + 1)
    ids = F.array_sort(F.collect_list("id"))
    return some.groupBy("dim", "h", "v").agg(ids.alias("ids")).withColumns({"first": F.col("ids")[0], "many": F.size("ids")})


def _windows(placed: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> dict[int, int]:
    """For each length the window that holds the share ``AIM`` of the sampled queries' true neighbours."""
    by = Window.partitionBy("dim").orderBy("h", "first")
    tries = queries.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= TRIES).select("dim", "first", "h", "v").collect()
    samples = {}
    for dim in sorted({r["dim"] for r in tries}):
        own = [r for r in tries if r["dim"] == dim]
        samples[dim] = (np.array([r["first"] for r in own], _I), np.array([r["h"] for r in own], _I), np.array([r["v"] for r in own], np.float64))
    if not samples:
        return {}
    found = points.select("dim", "first", "h", "many", "v").mapInArrow(_scan(samples, k), "dim long, query_id long, query_h long, first long, h long, score double")
    best = Window.partitionBy("dim", "query_id", "query_h").orderBy(F.desc("score"), "first", "h")
    true = F.broadcast(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n", "score"))  # TRIES x k rows for a length at most
    there = placed.filter("kind = 0").select("dim", "curve", "pos", "first", "h").join(true, ["dim", "first", "h"])
    asked = placed.filter("kind = 1").select("dim", "curve", F.col("pos").alias("at"), F.col("first").alias("query_id"), F.col("h").alias("query_h"))
    asked = asked.join(F.broadcast(true.select("dim", "query_id", "query_h").distinct()), ["dim", "query_id", "query_h"])
    gaps = there.join(asked, ["dim", "curve", "query_id", "query_h"]).groupBy("dim", "query_id", "query_h", "first", "h").agg(F.min(F.abs(F.col("pos") - F.col("at"))).alias("gap"))
    return {r["dim"]: int(r["w"]) for r in gaps.groupBy("dim").agg(F.percentile("gap", F.lit(AIM)).alias("w")).collect()}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k nearest candidates found for each query."""
    spark = vectors.sparkSession
    float_only = all(df.select(vector_col).dtypes[0][1] == "array<float>" for df in (vectors, queries))
    kind = "array<float>" if float_only else "array<double>"  # as stored; scores are taken in double precision
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumns({"dim": F.size("v").cast("long"), "h": F.xxhash64("v")})
    points = durable(_points(ready(vectors), k), "points")
    asked = durable(ready(queries).distinct().select("dim", "h", "v", F.array("id").alias("ids"), F.col("id").alias("first"), F.lit(1).alias("many")), "asked")
    every = points.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))

    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    by = Window.partitionBy("dim").orderBy("h", "first")
    most = {r["dim"]: r["most"] for r in points.groupBy("dim").agg(F.max(size).alias("most")).collect()}  # one row for each length
    drawn = points.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= FIT).select("dim", "v").collect()
    dims = {*most, *(r["dim"] for r in asked.select("dim").distinct().collect())}
    fits = {}
    for dim in dims:
        rows = np.array([r["v"] for r in drawn if r["dim"] == dim] or np.ones((1, dim)), np.float64)
        at = _lifted(rows, most.get(dim, 1.0), np.zeros(len(rows), bool)) @ _directions(dim)[0]
        fits[dim] = (most.get(dim, 1.0), at.mean(axis=0), np.maximum(at.std(axis=0), 1e-9))

    element = pa.float32() if float_only else pa.float64()
    fields = {"dim": pa.int64(), "curve": pa.int32(), "key": pa.int64(), "h": pa.int64(), "kind": pa.int32(), "first": pa.int64(), "many": pa.int32(), "ids": pa.list_(pa.int64()), "v": pa.list_(element)}
    spread = every.mapInArrow(_keys(fits, pa.schema(list(fields.items()))), f"dim long, curve int, key long, h long, kind int, first long, many int, ids array<long>, v {kind}")
    order = ["dim", "curve", "key", "h", "kind", "first"]
    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = durable(ordered, "curves")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # as many as partitions
        before.append((r["part"], total))
        total += r["count"]
    starts = F.broadcast(spark.createDataFrame(before, "part long, start long"))
    placed = placed.withColumn("part", part).join(starts, "part").withColumn("pos", F.col("start") + within).drop("part", "start", "at", "key")

    wide = _windows(placed, points, asked, k)
    windows = F.broadcast(spark.createDataFrame([(d, max(LEAST, wide.get(d, 0))) for d in sorted(dims)], "dim long, window long"))  # one row for each length
    tile = F.greatest(F.lit(256), F.least(F.lit(8192), F.floor(F.lit(TILE_VALUES) / F.col("dim"))))
    block = lambda p: F.greatest(F.floor(p / F.col("tile")), F.lit(0)).cast("long")
    tiles = placed.join(windows, "dim").withColumn("tile", tile).withColumn("own", block(F.col("pos")))
    tiles = tiles.withColumn("other", F.explode(F.sequence(block(F.col("pos") - F.col("window")), block(F.col("pos") + F.col("window")))))
    tiles = tiles.withColumns({"query_block": F.when(F.col("kind") == 1, F.col("own")).otherwise(F.col("other")), "row_block": F.when(F.col("kind") == 1, F.col("other")).otherwise(F.col("own"))})
    tiles = tiles.select("dim", "curve", "query_block", "row_block", "pos", "window", "h", "kind", "first", "many", "ids", "v")
    found = tiles.groupBy("dim", "curve", "query_block", "row_block").applyInArrow(_tile(k + 1), _FOUND).dropDuplicates(["query_id", "query_h", "first", "h"])
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
