"""BagMinHash classes against all pairs, and the behaviour of the registers."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from refloom.llm import minhash
from refloom.llm.components import components
from refloom.llm.tokens import words_of
from tests.llm.brute import classes, jaccard, shingles

SCHEMA = "doc_id long, text string, node string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)


def packed(text, value, weight, texts):
    h, offsets = minhash.sketches(text, value, weight, texts)
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int32)))
    return minhash.Sketches(pa.table({"sketch": lists, "n": np.bincount(text, weight, texts).astype(np.int64)}))


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5])):
            near = list(base)
            for _ in range(int(len(near) * rng.choice([0, 0.005, 0.02, 0.05, 0.1]))):
                near[rng.randrange(len(near))] = word()
            rows.append((n := n + 1, " ".join(near)))
    loop = ["ha"] * 60
    rows += [(500, " ".join(loop)), (501, " ".join(loop[:55])), (502, " ".join(loop[:30])), (503, "ha"), (504, "ha"), (505, "ho ho ho")]
    return rows


def test_classes_are_those_of_all_pairs(spark):
    rows = texts() + [(600, None), (601, ""), (602, " \n"), (603, "z " * 40000 + "end"), (604, "z " * 40000 + "end")]
    got = {r.doc_id: r.class_id for r in minhash.classes(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_one_of_each_class_is_kept(spark):
    rows = texts(2) + [(700, "same text in two rows of one id"), (700, "same text in two rows of one id"), (701, "same text in two rows of one id"), (None, None), (702, "")]
    source = frame(spark, rows)
    kept = minhash.keep_one(source)
    assert kept.columns == source.columns
    want = classes([x for x in rows if x[0] is not None])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_a_large_group_of_copies_keeps_links_to_other_texts(spark):
    base = [f"b{i}" for i in range(100)]
    near = [*base[:97], "x", "y", "z"]
    further = [*near[:3], "p", "q", *near[5:]]
    rows = [(i, " ".join(base)) for i in range(1000)] + [(2000 + i, " ".join([*base, f"t{i}"])) for i in range(200)] + [(3000, " ".join(near)), (3001, " ".join(further)), (3002, "quite another text of seven words")]
    got = {r.doc_id: r.class_id for r in minhash.classes(frame(spark, rows)).collect()}
    linked = jaccard(shingles(" ".join(near)), shingles(" ".join(further))) >= 0.8
    assert len({got[i] for i in [*range(1000), *range(2000, 2200), 3000]}) == 1
    assert got[3002] == 3002 and (got[3001] == 0) == linked


def test_empty(spark):
    assert minhash.classes(frame(spark, [])).count() == 0
    assert minhash.keep_one(frame(spark, [(1, None)])).count() == 1


@pytest.mark.parametrize("level", [0.3, 0.6, 0.9])
def test_registers_estimate_the_weighted_similarity(level):
    rng, found, m = np.random.default_rng(3), [], 512
    for _ in range(12):
        n = 200
        a = rng.integers(1, 30, n)
        b = np.where(rng.random(n) < level, a, rng.integers(0, 30, n))
        value = rng.integers(0, 2**63, n).astype(np.uint64)
        both = [minhash.registers(np.zeros((w > 0).sum(), np.int64), value[w > 0], w[w > 0], 1, m)[0] for w in (a, b)]
        found.append(((both[0] == both[1]).mean(), np.minimum(a, b).sum() / np.maximum(a, b).sum()))
    estimate, truth = np.mean(found, axis=0)
    assert abs(estimate - truth) < 0.02


@pytest.mark.parametrize(("size", "level"), [(40, 0.8), (300, 0.8), (3000, 0.8), (300, 0.5)])
def test_sketches_estimate_the_weighted_similarity(size, level):
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(200):
        value = rng.integers(0, 2**63, size).astype(np.uint64)
        weight = rng.integers(1, 3, size)
        both = int(size * 2 * level / (1 + level))
        ones = np.arange(size)
        cut = (size - both) // 2
        x, y = (packed(np.zeros(keep.sum(), np.int64), value[keep], weight[keep], 1) for keep in (ones < size - cut, ones >= cut))
        truth = weight[cut : size - cut].sum() / weight.sum()
        pairs.append((minhash.similarities(x, y, minhash.THRESHOLD)[0][0, 0], truth))
    estimate, truth = np.array(pairs).T
    assert abs((estimate - truth).mean()) < 0.01 and (estimate - truth).std() < 0.03
    assert size > 300 or np.allclose(estimate, truth)  # the whole multiset


def test_shingles_are_those_of_the_words():
    rows = ["a b c d e f a b c d e", "a b", "", "é  b\tc\nd e"]
    for w in words_of(pa.array(rows)):
        text, _, weight = minhash.shingles(w)
        for i, t in enumerate(rows):
            assert sorted(weight[text == i].tolist()) == sorted(shingles(t).values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, 200 + i) for i in range(50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(50)}}


def test_recall_at_the_threshold():
    rng, size, half, pairs = np.random.default_rng(5), 180, 20, 1500  # 160 of 200 shingles are common: 0.8 exactly
    value = rng.integers(0, 2**63, (pairs, size + half)).astype(np.uint64)
    sides = []
    for keep in (slice(0, size), slice(half, size + half)):
        v = value[:, keep].ravel()
        text, weight = np.repeat(np.arange(pairs), size), np.ones(len(v), np.int64)
        times = minhash.registers(text, v, weight, pairs, minhash.BANDS * minhash.ROWS).reshape(pairs, minhash.BANDS, minhash.ROWS)
        sides.append((times, packed(text, v, weight, pairs)))
    met = (sides[0][0] == sides[1][0]).all(axis=2).any(axis=1)
    found = [minhash.similarities(sides[0][1].some([i]), sides[1][1].some([i]), minhash.THRESHOLD)[1][0, 0] for i in range(pairs)]
    assert (met & found).mean() > 0.999


def test_clashing_columns_stay(spark):
    schema = "doc_id long, text string, _id long, _node string, _of int, id string, node string, `row` string, label int"
    rows = [(i, f"a b c d e f g h {i % 2}", 7, "n", 8, "i", "m", "r", 9) for i in range(4)]
    source = spark.createDataFrame(rows, schema)
    kept = minhash.keep_one(source)
    assert kept.columns == source.columns and sorted(tuple(r) for r in kept.collect()) == rows[:2]


def test_chunks_of_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 5)
    rng = random.Random(9)
    rows, words = [], [f"w{i}" for i in range(120)]
    for i in range(150):  # a chain of near copies: neighbours are links, far ones are not
        words = [*words]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in minhash.classes(frame(spark, rows)).collect()}
    assert got == classes(rows)
