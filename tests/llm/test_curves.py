"""Nearest neighbours on Hilbert curves against all products."""

from __future__ import annotations

import functools
import math
import operator
import random

import numpy as np
import pytest

from refloom.llm import curves

SCHEMA = "vec_id long, embedding array<double>, id int, v string, h long"


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "clash", 2) for x in rows], SCHEMA)


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def product(v, c):
    """Left to right in doubles (``sum`` would compensate)."""
    return functools.reduce(operator.add, (a * b for a, b in zip(v, c, strict=True)), 0.0)


def brute(rows, queries, k):
    out = set()
    asked = {(q, tuple(v)) for q, v in queries if q is not None and fine(v)}
    for q in {q for q, _ in asked}:
        scores = sorted((-product(v, c), i) for q2, v in asked if q2 == q for i, c in rows if i is not None and i != q and fine(c) and len(c) == len(v))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


def found(spark, rows, queries, k=20):
    return {tuple(r) for r in curves.nearest(frame(spark, rows), frame(spark, queries), k).select("query_id", "rank", "vec_id", "score").collect()}


def test_hilbert_keys_step_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = curves.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("tile", [1 << 18, 64])
def test_all_cases_where_the_window_covers_the_table(spark, monkeypatch, tile):
    monkeypatch.setattr(curves, "TILE_VALUES", tile)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * (1 + i % 3) for _ in range(8)]) for i in range(300)]  # norms differ
    rows += [(300 + i, rows[i % 3][1]) for i in range(90)]  # ties
    rows += [(1000, None), (1001, []), (1002, [None] + [1.0] * 7), (1003, [float("nan")] + [1.0] * 7), (1004, [float("inf")] + [1.0] * 7), (1005, [0.0] * 8)]
    rows += [(None, [0.5] * 8), (1006, [0.5] * 3), (1020, [0.25] * 3), (20, rows[20][1]), (40, rows[3][1])]
    queries = [x for x in rows if x[0] is not None and x[0] % 20 == 0]
    assert found(spark, rows, queries) == brute(rows, queries, 20)


def test_small_tiles_give_the_same_windows(spark, monkeypatch):
    """Windows wider and narrower than a tile: found rows do not depend on how they are dealt."""
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 6)))]
    queries = rows[::20]
    monkeypatch.setattr(curves, "LEAST", 90)
    wide = found(spark, rows, queries, 5)
    monkeypatch.setattr(curves, "TILE_VALUES", 6)  # tiles of 256 at least
    assert found(spark, rows, queries, 5) == wide


def test_recall_with_narrow_windows(spark, monkeypatch):
    """The window is measured: vectors near a few centres need little of the table, and most neighbours are found."""
    monkeypatch.setattr(curves, "LEAST", 1)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    data = centres[rng.integers(30, size=3000)] + 0.15 * rng.normal(size=(3000, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    seen = {}
    measure = curves._windows
    monkeypatch.setattr(curves, "_windows", lambda *a: seen.setdefault("w", measure(*a)))
    got, want = found(spark, rows, rows[::20]), brute(rows, rows[::20], 20)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    assert seen["w"][24] < 300  # a tenth of the table
    exact = {(q, i): product(rows[q][1], rows[i][1]) for q, _, i, _ in got}
    assert all(exact[q, i] == s for q, _, i, s in got)


def test_half_of_the_rows_equal(spark, monkeypatch):
    """Copies are one point: no tile and no window grows with them, ties go to the smaller ids."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(400)] + [(1000 + i, [0.3] * 5) for i in range(400)]
    queries = [x for x in rows if x[0] % 40 == 0]
    assert found(spark, rows, queries) == brute(rows, queries, 20)
    points = curves._points(frame(spark, rows).selectExpr("vec_id as id", "embedding as v", "5L as dim", "xxhash64(embedding) as h"), 20)
    assert points.count() == 401 and points.selectExpr("max(many)").first()[0] == 21


def test_empty(spark):
    assert curves.nearest(frame(spark, []), frame(spark, [])).count() == 0
    assert curves.nearest(frame(spark, [(20, [1.0])]), frame(spark, [(20, [1.0])])).count() == 0
    assert curves.nearest(frame(spark, []), frame(spark, [(20, [1.0])])).count() == 0
    assert curves.nearest(frame(spark, [(1, [1.0])]), frame(spark, [])).count() == 0


def test_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(curves, "LEAST", 20)
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(800, 10)))]
    assert found(spark, rows, rows[::20]) == found(spark, rows, rows[::20])
