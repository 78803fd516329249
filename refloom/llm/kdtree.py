"""Exact top-k search by inner product with one KD-tree for each shard.

Vectors are dealt to shards by space: median splits on the widest dimension of a
sample of at most ``SAMPLE`` vectors of each length cut it into cells, and every
vector goes to its cell (to one of several shards of it, by hash, where cells would
hold more than ``SHARD``).  A shard is one packed KD-tree with median splits and
tight bounding boxes.  The bound of a box for a query is the sum over dimensions of
the larger of q x low and q x high.

1. every query is searched in its own cell; its kth score there is its bound;
2. runs of packed blocks of queries meet packs of shards; of a pack a query visits the
   shards whose box reaches its kth score, one after the other, and what it finds in one
   is its bound in the next;
3. a visited shard is searched leaf by leaf, best bound first, until no bound
   reaches the query's kth score, the one it brought or a better one found here.

Shards and blocks are rows of bytes in the narrowest integers that hold them, a few to a
file, since a scan decodes the rows of a file together; a task holds one pack and one run
at a time, whatever the size of the table, and gives at most k rows for a query and pack.

The best k of all shards are merged by a window per query.  The sample decides only
which shard a vector lies in, never what is found.  Of equal vectors the k + 1 with the
smallest ids are searched: no other can be among the k best of a query, since the query's
own row is one of them at most; they are counted in salted parts, so that no task
gathers a vector that very many rows share.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do null ids; vectors only meet vectors of their
length; a candidate with the query's id is the query's own; repeated query rows
(of one id and vector) are one query, and rows of one id with different vectors are
searched each and merged under the id; repeated candidates each count; ties go to
the smaller id; fewer than k candidates give all; empty tables give empty results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.durable import durable

SHARD = 4096
LEAF = 128
QUERY_BLOCK = 1024
#: Shards in a pack and blocks in a run, at most; groups of a pack and a run, at least, where there are so many shards and runs; vectors that decide the cells.
PACK = 16
RUN = 4
GROUPS = 64
SAMPLE = 20_000
#: Packed shards and blocks in a file, at most.
FILE_ROWS = 16
#: Parts that equal vectors are first counted in.
SALTS = 32

_I = np.int64


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; null if a component is not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _most(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _narrow(rows: np.ndarray) -> np.ndarray:
    """Rows in the narrowest integers that hold them."""
    return rows.astype(next((t for t in (np.int8, np.int16, np.int32) if _most(rows) <= np.iinfo(t).max), _I))


def _packed(head: list[int], wide: list[np.ndarray], narrow: list[np.ndarray]) -> bytes:
    """Whole numbers, then arrays of longs, then arrays of one narrower type, whose width is the first number."""
    return b"".join(x.tobytes() for x in (np.array([narrow[0].itemsize, *head], _I), *wide, *narrow))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table["id"], _I)
    values = table["v"].combine_chunks()
    return ids, np.asarray(values.flatten(), _I).reshape(len(ids), -1)


def _tree(key, table):
    """One packed shard: rows in leaf order, leaf starts and boxes."""
    ids, rows = _matrix(table)
    order = np.lexsort((ids,))
    ids, rows = ids[order], rows[order]
    leaves, work = [], [np.arange(len(ids))]
    while work:
        some = work.pop()
        if len(some) <= LEAF:
            leaves.append(some)
            continue
        part = rows[some]
        spread = part.max(axis=0) - part.min(axis=0)
        by = np.argsort(part[:, int(np.argmax(spread))], kind="stable")
        half = len(some) // 2
        work += [some[by[half:]], some[by[:half]]]
    starts = np.cumsum([0] + [len(x) for x in leaves]).astype(_I)
    small, every = _narrow(rows), np.concatenate(leaves)
    low, high = (np.array([getattr(small[x], side)(axis=0) for x in leaves], small.dtype) for side in ("min", "max"))
    blob = _packed([len(ids), rows.shape[1], len(leaves)], [ids[every], starts], [small[every], low, high])
    return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "blob": pa.array([blob], pa.binary())})


class Shard:
    """A packed shard, read where it lies: ids, rows, starts and boxes of its leaves."""

    def __init__(self, blob) -> None:
        width, n, d, leaves = (int(x) for x in np.frombuffer(blob, _I, 4))
        longs = np.frombuffer(blob, _I, n + leaves + 1, 32)
        self.ids, self.starts = longs[:n], longs[n:]
        flat = np.frombuffer(blob, f"i{width}", -1, 32 + longs.nbytes).reshape(-1, d)
        self.rows, self.low, self.high = flat[:n], flat[n : n + leaves], flat[n + leaves :]

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """The most that a row of the shard can score with each query."""
        return _bounds(queries, self.low.min(axis=0, keepdims=True), self.high.max(axis=0, keepdims=True))[:, 0]


def cells(rows: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """Splits (dimension, value, left, right) of a sample into n cells; a negative child -c - 1 is cell c."""
    splits: list[tuple[int, int, int, int]] = []
    work, made = [(np.arange(len(rows)), n, -1, 0)], 0
    while work:
        some, parts, parent, side = work.pop()
        spread = np.ptp(rows[some], axis=0) if len(some) > 1 else np.zeros(1)
        if parts <= 1 or spread.max() == 0:
            here, made = -made - 1, made + 1
        else:
            d = int(np.argmax(spread))
            values = np.sort(rows[some, d])
            cut = int(values[len(some) * (parts // 2) // parts])
            cut = cut if cut > values[0] else int(values[values > values[0]][0])  # both sides hold some
            here, below = len(splits), rows[some, d] < cut
            splits.append((d, cut, 0, 0))
            work += [(some[~below], parts - parts // 2, here, 3), (some[below], parts // 2, here, 2)]
        if parent >= 0:
            splits[parent] = tuple(here if i == side else x for i, x in enumerate(splits[parent]))
    return splits


def _place(plans: dict[int, tuple[list, int]]):
    """Deal vectors (id, v, dim) to the shards of their cells; ``plans`` has splits and shards per cell by length."""

    def run(batches):
        for batch in batches:
            dim = np.asarray(batch["dim"], _I)
            shard = np.zeros(len(dim), _I)
            for d in np.unique(dim):
                splits, each = plans[int(d)]
                at = np.flatnonzero(dim == d)
                rows = np.asarray(batch["v"].take(pa.array(at)).flatten(), _I).reshape(len(at), int(d))
                cell, node = np.zeros(len(at), _I), np.zeros(len(at), _I)
                table = np.array(splits, _I).reshape(-1, 4)
                live = np.arange(len(at)) if len(table) else np.zeros(0, _I)
                while len(live):
                    here = table[node[live]]
                    child = np.where(rows[live, here[:, 0]] < here[:, 1], here[:, 2], here[:, 3])
                    cell[live[child < 0]] = -child[child < 0] - 1
                    node[live] = child
                    live = live[child >= 0]
                shard[at] = cell * each + np.asarray(batch["draw"], _I)[at] % each
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], batch["dim"], pa.array(shard)], ["id", "v", "dim", "shard"])

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floats or doubles where they are exact."""
    most = _most(a) * _most(b) * a.shape[1]
    if most < 2**53:
        real = np.float32 if most < 2**24 else np.float64
        return (a.astype(real) @ b.T.astype(real)).astype(_I)
    return a.astype(_I) @ b.T.astype(_I)


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that a row of each box can score with each query."""
    return _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)


def _merge(best: np.ndarray, names: np.ndarray, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Take scores and ids of the queries ``at`` among their k best."""
    k, some = best.shape[1], np.unique(at)
    at = np.concatenate([np.repeat(some, k), at])
    scores, ids = np.concatenate([best[some].ravel(), scores]), np.concatenate([names[some].ravel(), ids])
    order = np.lexsort((ids, -scores, at))
    first = np.searchsorted(at[order], some)
    order = order[first[:, None] + np.arange(k)]  # each query has k at least
    best[some], names[some] = scores[order], ids[order]


def search_shard(shard: Shard, ids: np.ndarray, queries: np.ndarray, best: np.ndarray, names: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Improve the best scores and ids (queries x k, best first) by a shard; scores under the floor do not matter."""
    bound = _bounds(queries, shard.low, shard.high)
    turn = np.argsort(-bound, axis=1, kind="stable")
    live, step, width = np.arange(len(queries)), 0, 1
    while step < bound.shape[1]:  # one leaf, then two, then four: the first ones give a bound, of the others many are read or none
        leaf, least = turn[live, step : step + width], np.maximum(best[live, -1], floor[live])
        open_ = bound[live[:, None], leaf] >= least[:, None]
        some = open_[:, 0]
        live, leaf, least, open_ = live[some], leaf[some], least[some], open_[some]
        if not len(live):
            break
        found = []
        for x in np.unique(leaf[open_]):
            here = ((leaf == x) & open_).any(axis=1)
            some, own = live[here], shard.ids[shard.starts[x] : shard.starts[x + 1]]
            scores = _product(queries[some], shard.rows[shard.starts[x] : shard.starts[x + 1]])
            row, place = np.nonzero((scores >= least[here, None]) & (own[None] != ids[some, None]))
            found.append((some[row], scores[row, place], own[place]))
        at, scores, own = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(at):
            _merge(best, names, at, scores, own)
        step, width = step + width, width * 2
    return best, names


_NONE = np.iinfo(_I).min + 1
_FOUND = "query_id long, vec_id long, score long, kth long, v array<long>"


def _found(ids, queries, best, names, carry: bool) -> pa.Table:
    """Scores found; with ``carry`` a first row for each query with its kth score and vector."""
    real = best > _NONE
    k = best.shape[1]
    rows = {"query_id": np.repeat(ids, k).reshape(best.shape)[real], "vec_id": names[real], "score": best[real]}
    n, m = len(rows["score"]), len(ids) if carry else 0
    lists = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(m + 1) * queries.shape[1], np.full(n, m * queries.shape[1])].astype(np.int32)), pa.array(queries[:m].ravel(), pa.int64()))
    head = [pa.array(np.r_[ids[:m], rows["query_id"]]), *[pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(rows[c])]) for c in ("vec_id", "score")]]
    return pa.table([*head, pa.concat_arrays([pa.array(best[:m, -1]), pa.nulls(n, pa.int64())]), lists], ["query_id", "vec_id", "score", "kth", "v"])


def _nothing() -> pa.Table:
    return _found(np.zeros(0, _I), np.zeros((0, 0), _I), np.zeros((0, 1), _I), np.zeros((0, 1), _I), False)


def _home(k: int):
    """The queries of a shard searched in it: what is found, and the kth score of each."""

    def run(key, shards, asked):
        if not asked.num_rows:
            return _nothing()
        ids, queries = _matrix(asked)
        best, names, floor = np.full((len(ids), k), _NONE), np.full((len(ids), k), np.iinfo(_I).max), np.full(len(ids), _NONE)
        for blob in shards["blob"]:
            best, names = search_shard(Shard(blob.as_buffer()), ids, queries, best, names, floor)
        return _found(ids, queries, best, names, True)

    return run


def _block(key, asked):
    """A block of queries as one packed row."""
    ids, queries = _matrix(asked)
    kth, home = np.asarray(asked["kth"], _I), np.asarray(asked["home"], _I)
    blob = _packed([*queries.shape], [ids, kth, home], [_narrow(queries)])
    return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "asked": pa.array([blob], pa.binary())})


def _away(k: int):
    """The blocks of a run searched in the shards of a pack, but for every query's own."""

    def run(key, pack, blocks):
        parts = [_nothing()]
        shards = [(x, Shard(blob.as_buffer())) for x, blob in zip(pack["shard"].to_pylist(), pack["blob"], strict=True)]
        for packed in blocks["asked"] if shards else ():
            blob = packed.as_buffer()
            width, n, d = (int(x) for x in np.frombuffer(blob, _I, 3))
            ids, floor, home = np.frombuffer(blob, _I, 3 * n, 24).reshape(3, n)
            queries = np.frombuffer(blob, f"i{width}", -1, 24 + 24 * n).reshape(n, d)
            best, names = np.full((n, k), _NONE), np.full((n, k), np.iinfo(_I).max)
            for x, shard in shards:
                some = np.flatnonzero((home != x) & (shard.reach(queries) >= np.maximum(best[:, -1], floor)))
                if len(some):
                    best[some], names[some] = search_shard(shard, ids[some], queries[some], best[some], names[some], floor[some])
            parts.append(_found(ids, queries, best, names, False))
        return pa.concat_tables(parts)

    return run


def _possible(vectors: DataFrame, k: int) -> DataFrame:
    """Without the rows that can be no result: of equal vectors all but those of the k + 1 smallest ids."""
    salted, whole = Window.partitionBy("v", "salt").orderBy("id"), Window.partitionBy("v").orderBy("id")
    some = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("nth", F.row_number().over(salted)).filter(F.col("nth") <= k + 1)
    return some.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= k + 1).drop("salt", "nth")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k best candidates of each query."""
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).filter("id is not null and v is not null").withColumns({"dim": F.size("v").cast("long"), "draw": F.shiftrightunsigned(F.xxhash64("id", "v"), 1)})
    spark = vectors.sparkSession
    every, asked = durable(_possible(ready(vectors), k), "vectors"), ready(queries).distinct()
    plans: dict[int, tuple[list, int]] = {}
    shards_of: dict[int, int] = {}
    for dim, n in sorted((r["dim"], r["count"]) for r in every.unionByName(asked).groupBy("dim").count().collect()):  # as many as lengths
        some = every.filter(F.col("dim") == dim).orderBy("draw", "id").limit(SAMPLE).select("v").collect()
        shards = max(1, -(-n // SHARD))
        most = max(1, min(shards, len(some) // 8))
        plans[dim] = (cells(np.array([r["v"] for r in some], _I).reshape(len(some), dim), most), max(1, -(-shards // most)))
        shards_of[dim] = (len(plans[dim][0]) + 1) * plans[dim][1]
    placed = lambda df: df.mapInArrow(_place(plans), "id long, v array<long>, dim long, shard long")
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    trees = durable(placed(every).groupBy("dim", "shard").applyInArrow(_tree, "dim long, shard long, blob binary"), "trees", file_rows=FILE_ROWS)
    homes = durable(placed(asked), "queries")
    # a shard that very many queries call home is searched in parts
    parts = durable(homes.groupBy("dim", "shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts")), "parts")
    here = trees.join(parts, ["dim", "shard"]).select("dim", "shard", "blob", every_of(F.col("parts")).alias("part"))
    asked_here = homes.join(parts, ["dim", "shard"]).select("dim", "shard", "id", "v", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    by = ["dim", "shard", "part"]
    near = durable(here.groupBy(*by).cogroup(asked_here.groupBy(*by)).applyInArrow(_home(k), _FOUND), "near")
    bounds = near.filter("v is not null and kth is not null").select(F.col("query_id").alias("id"), "v", "kth")
    n_blocks = max(1, -(-homes.count() // QUERY_BLOCK))
    away = homes.select("id", "v", "dim", F.col("shard").alias("home"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")).join(bounds, ["id", "v"], "left").withColumn("kth", F.coalesce("kth", F.lit(int(_NONE))))
    blocks = durable(away.groupBy("dim", "block").applyInArrow(_block, "dim long, block long, asked binary"), "blocks", file_rows=FILE_ROWS)
    runs = -(-n_blocks // RUN)
    pack = {dim: max(1, min(PACK, n * runs // GROUPS)) for dim, n in shards_of.items()}
    sizes = spark.createDataFrame([(dim, pack[dim], -(-n // pack[dim])) for dim, n in shards_of.items()], "dim long, pack_size long, packs long")
    by = ["dim", "pack", "run"]
    open_ = trees.join(F.broadcast(sizes), "dim").select("dim", F.floor(F.col("shard") / F.col("pack_size")).alias("pack"), "shard", "blob", every_of(F.lit(runs).cast("long")).alias("run"))
    visits = blocks.join(F.broadcast(sizes), "dim").select("dim", every_of(F.col("packs")).alias("pack"), "asked", F.floor(F.col("block") / RUN).alias("run"))
    far = open_.groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(_away(k), _FOUND)
    found = near.unionByName(far).filter("vec_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
