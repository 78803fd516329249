"""Weighted fair queueing: targets, taken words and order."""

from __future__ import annotations

import random

import pytest

from refloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, -1, "clash") for i, t, s in rows], SCHEMA)


def water(sizes, weights, cap=3):
    """Targets by repeated resharing."""
    total, full = float(sum(sizes)), {}
    while True:
        left = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(full.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i: float(cap * sizes[i]) for i in left if share[i] > cap * sizes[i]}
        if not over:
            return [full.get(i, share.get(i)) for i in range(len(sizes))]
        full |= over


def test_targets_and_taken(spark):
    rng = random.Random(3)
    counts = {"a": 300, "b": 40, "c": 5, "d": 60, None: 30}
    rows = [(n * 1000 + k, " ".join("w" * rng.randrange(1, 40)), s) for n, (s, c) in enumerate(counts.items()) for k in range(c)]
    rows += [(9999, None, "a"), (9998, " \t\n", "a"), (1, "x y", "b"), (1, "x y", "b")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in counts}
    want = water([size[s] for s in ["a", "b", "c", "d", None]], [1, 2, 3, 1, 2])
    for s, target in zip(["a", "b", "c", "d", None], want, strict=True):
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size[s]} and mine[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in mine) - target) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    finish = [r.first_finish for r in got]
    assert finish == sorted(finish)


def test_emitted_copies_follow_the_finish_times(spark):
    rows = [(i, "a b c", "x") for i in range(9)] + [(i, "a b", "y") for i in range(20, 24)]
    mixed = mixing.mix(frame(spark, rows))
    copies = mixing.emit(mixed).collect()
    assert [c.finish for c in copies] == sorted(c.finish for c in copies)
    assert sum(c.words for c in copies) == sum(r.taken for r in mixed.collect())


def test_empty_tables_and_texts(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, "", "a"), (None, None, None)])).collect()] == [0, 0]


def test_the_words_are_those_of_the_sorted_copies_up_to_the_budget(spark):
    rng = random.Random(8)
    sizes = {"a": 400, "b": 150, "c": 30, None: 20}
    rows = [(n * 1000 + k if k % 9 else None, " ".join("w" * rng.randrange(1, 30)), s) for n, (s, c) in enumerate(sizes.items()) for k in range(c)]
    mixed = mixing.mix(frame(spark, rows))
    copies = mixing.emit(mixed).collect()
    budget = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(c.words for c in copies) - budget) <= len(sizes)
    # at every finish time the running sum of the sorted copies is the time's share of the budget, but for documents in service
    running = 0
    for c in copies:
        running += c.words
        assert budget * min(c.finish, 1.0) - 29 * len(sizes) - len(sizes) <= running <= budget * min(c.finish, 1.0) + 29 * len(sizes)
    # cutting the sorted stream of whole documents at the budget takes the same, but for those in service
    taken = {s: sum(c.words for c in copies if c.source == s) for s in sizes}
    whole, left = dict.fromkeys(sizes, 0), budget
    for c in copies:
        step = min(c.size, left)
        whole[c.source], left = whole[c.source] + step, left - step
    assert all(abs(whole[s] - taken[s]) < 30 for s in sizes)
