"""Exact top-k against all products."""

from __future__ import annotations

import math
import random

import pytest

from refloom.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>, id int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA)


def brute(rows, queries, k):
    import struct

    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(64 * f32(x)) for x in v]
    out = set()
    for q, v in {(q, tuple(v)) for q, v in queries if q is not None and fine(v)}:
        scores = sorted((-sum(a * b for a, b in zip(whole(v), whole(c), strict=True)), i) for i, c in rows if i is not None and i != q and fine(c) and len(c) == len(v))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize(("shard", "leaf", "run", "sample"), [(4096, 128, 4, 20_000), (50, 4, 2, 20_000), (7, 1, 1, 100)])
def test_top_k(spark, monkeypatch, shard, leaf, run, sample):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("RUN", run), ("QUERY_BLOCK", 5), ("PACK", 3), ("SAMPLE", sample)):
        monkeypatch.setattr(kdtree, name, value)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(1000, None), (1001, []), (1002, [None] + [0.0] * 7), (1003, [float("nan")] + [0.0] * 7), (1004, [float("inf")] + [1.0] * 7), (None, [0.5] * 8), (1006, [0.5] * 3), (1020, [0.25] * 3), (20, rows[20][1])]
    queries = [x for x in rows if x[0] is not None and x[0] % 20 == 0]
    got = {tuple(r) for r in kdtree.top_k(frame(spark, rows), frame(spark, queries), 20).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, queries, 20)


def test_empty(spark):
    assert kdtree.top_k(frame(spark, []), frame(spark, [])).count() == 0
    assert kdtree.top_k(frame(spark, [(20, [1.0])]), frame(spark, [(20, [1.0])])).count() == 0


def test_large_products_are_whole():
    import numpy as np

    a, b = np.full((1, 4), 2**29, np.int64), np.full((1, 4), 2**29 + 1, np.int64)
    assert kdtree._product(a, b)[0, 0] == 4 * 2**29 * (2**29 + 1)


def test_cells_hold_like_shares_and_boxes_prune():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(c, 5, (500, 3)).astype(np.int64) for c in (-200, 0, 200, 400)])
    splits = kdtree.cells(rows, 4)
    v = pa.array(rows.tolist(), pa.list_(pa.int64()))
    n = len(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), v, pa.array(np.full(n, 3)), pa.array(np.zeros(n, np.int64))], ["id", "v", "dim", "draw"])
    shard = np.asarray(next(kdtree._place({3: (splits, 1)})([batch]))["shard"])
    assert sorted(np.bincount(shard).tolist()) == [500] * 4  # each cluster is a cell
    assert kdtree.cells(np.zeros((50, 2), np.int64), 8) == []  # equal vectors cannot be split


def test_one_id_with_two_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 2.0])]
    got = [tuple(r) for r in kdtree.top_k(frame(spark, rows), frame(spark, rows[:2]), 3).orderBy("rank").collect()]
    assert [g[:1] + g[2:] for g in got] == [(20, 2, 64 * 128), (20, 1, 64 * 64), (20, 1, 64 * 32)]


def test_half_of_the_rows_equal(spark, monkeypatch):
    """Equal vectors leave k + 1 rows, so no shard holds them all, and the results are those of all rows."""
    monkeypatch.setattr(kdtree, "SHARD", 60)
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(1000 + i, [0.0] * 4) for i in range(200)] + [(2000 + i, [0.5, 0.25, 0.5, 0.5]) for i in range(100)]
    rng.shuffle(rows)
    queries = [x for x in rows if x[0] % 20 == 0]
    got = {tuple(r) for r in kdtree.top_k(frame(spark, rows), frame(spark, queries), 7).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, queries, 7)
    left = kdtree._possible(frame(spark, rows).selectExpr("vec_id as id", "embedding as v"), 7)
    assert left.count() == 300 + 8 + 8


def test_packed_rows_are_narrow_and_few_to_a_file(spark, monkeypatch):
    """A scan decodes the rows of a file together: however many shards there are, a file holds FILE_ROWS of them at most."""
    for name, value in (("SHARD", 20), ("QUERY_BLOCK", 2), ("FILE_ROWS", 3)):
        monkeypatch.setattr(kdtree, name, value)
    written = {}
    keep = kdtree.durable
    monkeypatch.setattr(kdtree, "durable", lambda df, name, *a, **k: written.setdefault(name, keep(df, name, *a, **k)))
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(600)]
    kdtree.top_k(frame(spark, rows), frame(spark, rows[:40])).count()
    for name, column in (("trees", "blob"), ("blocks", "asked")):
        table = written[name]
        most = table.selectExpr("_metadata.file_path as f").groupBy("f").count().selectExpr("max(count)", "sum(count)").first()
        assert most[0] <= 3 < most[1]
        assert table.selectExpr(f"max(length({column}))").first()[0] < 20 * 8 * 8  # a shard's components as longs alone


def test_a_pack_gives_k_rows_a_query():
    """What a query finds in one shard of a pack is its bound in the next, and its own shard is passed over."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = rng.integers(-64, 64, (400, 5))
    table = lambda at, **more: pa.table({"id": at, "v": pa.array(rows[at].tolist(), pa.list_(pa.int64())), **more})
    pack = pa.concat_tables([kdtree._tree((pa.scalar(5), pa.scalar(x)), table(np.arange(100 * x, 100 * x + 100))) for x in range(4)])
    asked = np.array([7, 107, 207])
    block = kdtree._block((pa.scalar(5), pa.scalar(0)), table(asked, kth=np.full(3, kdtree._NONE), home=asked // 100))
    got = kdtree._away(6)(None, pack, block).to_pylist()
    for q in asked:
        others = [(-int(rows[q] @ rows[i]), i) for i in range(400) if i // 100 != q // 100]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == q] == sorted(others)[:6]


def test_wide_components(spark):
    rows = [(i, [float(2**k * (i % 7 - 3)) for k in (0, 9, 22)]) for i in range(60)]
    got = {tuple(r) for r in kdtree.top_k(frame(spark, rows), frame(spark, rows[:21:20]), 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, rows[:21:20], 5)
