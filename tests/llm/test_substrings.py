"""Substring dedup against all windows of all documents."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from refloom.llm import substrings
from tests.llm.brute import SPACED, cut

SCHEMA = "doc_id long, text string, part string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)


def corpus(seed, vocabulary, docs=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(vocabulary)
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(15)]
    rows = []
    for i in rng.sample(range(1000), docs):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(30))]
            parts += p[rng.randrange(3) :] if rng.random() < 0.3 else p
        rows.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 3000), (2, 40), (3, 3), (4, 1)])
@pytest.mark.parametrize("block", [256, 7])
def test_removed_words(spark, monkeypatch, seed, size, block):
    monkeypatch.setattr(substrings, "BLOCK_DOCS", block)
    monkeypatch.setattr(substrings, "INDEX_BYTES", 4000)
    rows = corpus(seed, [f"w{i}é" for i in range(size)]) + [(2000, None), (2001, ""), (2002, " "), (1, "t " * 20000)]
    got = substrings.parse(frame(spark, rows), cut=False).collect()
    assert Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == cut(rows)


def test_equal_and_null_ids(spark):
    long = " ".join(f"x{i}" for i in range(30))
    rows = [(5, long), (5, long), (9, "a " + long), (None, "b " + long), (None, long)]
    got = substrings.parse(frame(spark, rows), cut=False).collect()
    assert sorted((r.row.doc_id or -1, r.n_removed) for r in got) == [(-1, 30), (-1, 30), (5, 0), (5, 0), (9, 30)]


def test_text_is_cut_and_factors_name_the_reference(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"one\n{passage} two"), (2, f"three\n{passage}\nfour  five"), (3, passage), (4, None)]
    source = frame(spark, rows)
    parsed = substrings.parse(source)
    got = {r.row.doc_id: r for r in parsed.collect()}
    assert set(got[1].row.asDict()) == set(source.columns) - {"text"} and got[1].row.part == "clash"
    assert got[1].text == rows[0][1] and SPACED.findall(got[2].text) == ["three", "four", "five"]
    assert got[3].text.strip() == "" and got[4].text is None
    assert [(f.first, f.last, f.ref, f.ref_word) for f in got[2].factors] == [(1, 20, 1, 1)]


def test_factors_end_where_the_reference_does_and_boundaries_are_checked(spark):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    # 3 is a then b: two factors; the windows over the joint stand in 2 alone, by no snippet of theirs
    rows = [(1, " ".join(["s", *a, "t"])), (2, " ".join([*a[-8:], *b[:8], "u"])), (3, " ".join([*a, *b])), (4, " ".join([*b, "v", *a[:12]]))]
    got = {r.row.doc_id: r for r in substrings.parse(frame(spark, rows)).collect()}
    spans = [(f.first, f.last, f.ref, f.ref_word) for f in got[3].factors]
    assert spans == [(0, 29, 1, 1), (22, 37, 2, 0)] and got[3].n_removed == 38
    assert [(f.first, f.last, f.ref, f.ref_word) for f in got[4].factors] == [(0, 29, 3, 30)]
    assert all(f.last - f.first + 1 >= substrings.WINDOW for r in got.values() for f in r.factors)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a b")],
        [(1, None)],
        [(1, "a b c"), (2, "d e f")],
        [(1, " ".join(f"x{i}" for i in range(50))), (2, " ".join(f"y{i}" for i in range(50)))],
        [(1, " ".join(f"x{i}" for i in range(50))), (2, " ".join(f"x{i}" for i in range(50)))],
        [(None, " ".join(f"x{i}" for i in range(13))), (2, " ".join(f"x{i}" for i in range(13)))],
    ],
)
def test_small_tables(spark, rows):
    got = substrings.parse(frame(spark, rows)).collect()
    assert Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == cut(rows)


def test_clashing_columns_and_kinds_of_ids(spark):
    schema = "`doc_id` int, `text` string, `_id` long, `_text` string, `block` int, `row` string, `n_removed` string, `a b` double"
    long = " ".join(f"x{i}" for i in range(20))
    source = spark.createDataFrame([(1, long, 5, "t", 6, "r", "n", 0.5), (2, long, 5, "t", 6, "r", "n", 0.5)], schema)
    got = {r.row.doc_id: r for r in substrings.parse(source).collect()}
    assert got[2].n_removed == 20 and got[2].row.asDict() == {"doc_id": 2, "_id": 5, "_text": "t", "block": 6, "row": "r", "n_removed": "n", "a b": 0.5}
    with pytest.raises(ValueError, match="whole-number"):
        substrings.parse(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_empty(spark):
    assert substrings.parse(frame(spark, [])).count() == 0
