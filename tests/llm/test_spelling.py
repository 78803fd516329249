"""Spelling groups against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from refloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, side int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA)


def distance_one(a, b):
    drop = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return a in drop(b) or b in drop(a)


def count(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: [y for y in words if distance_one(w, y)] for w in words}
    form = {}
    for w, ys in near.items():
        best = min(ys, key=lambda y: (-words[y], y), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def found(spark, rows):
    got = [tuple(r) for r in spelling.group(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(rng, n=300):
    stems = ["kitten", "sitting", "étude", "naïvely", "nation", "station", "notation", "aaaaa", "aaaaaa", "abcabc", "Ünder", "ÿÿÿÿÿ", "word", "÷×÷×÷×"]
    edit = lambda w: rng.choice([w, w, w[: (i := rng.randrange(len(w)))] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
    rows = [(rng.choice([None, *range(200)]), " ".join(rng.choice([str.upper, str])(edit(rng.choice(stems))) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [(1, None), (2, ""), (3, "z" * 5000 + " " + "z" * 5000 + "1" + "z" * 4999), (4, "z" * 5000 + "日kitten_sitting")] + rows[:20]


@pytest.mark.parametrize(("held", "shard", "hot"), [(200_000, 4_000, 64), (50, 40, 64), (50, 40, 2), (200_000, 4_000, 0)])
def test_all_cases(spark, monkeypatch, held, shard, hot):
    for name, value in (("HELD", held), ("SHARD", shard), ("HOT", hot)):
        monkeypatch.setattr(spelling, name, value)
    rows = corpus(random.Random(7))
    words = count(rows)
    assert len(words) > 100 and {len(w) for w in words} >= {5, 6, 7}
    assert found(spark, rows) == brute(words)


def test_one_half_shared_by_most_words(spark):
    """A third and more of the words share an end: they leave the automata and are joined by what is left of the rest."""
    rng = random.Random(3)
    rests = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(700)}
    rows = [(k, " ".join([r + "ation"] * rng.randint(3, 9))) for k, r in enumerate(sorted(rests))]
    words = count(rows)
    assert found(spark, rows) == brute(words)


def test_chain_of_forms(spark):
    words = [("abcde", 3), ("abcdef", 6), ("abcdefg", 12), ("abcdefgh", 24), ("bbcdefgh", 48), ("bbcdefghi", 96)]
    rows = [(None, " ".join([w] * n)) for w, n in words]
    got = {r[0]: r for r in found(spark, rows)}
    assert set(got.values()) == brute(count(rows))
    assert got["abcde"][1:3] == ("abcdef", "bbcdefghi")


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "tiny words only")]) == set()


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in "xy")
        if a != b:
            assert spelling.one_edit(a, b) == distance_one(a, b)
