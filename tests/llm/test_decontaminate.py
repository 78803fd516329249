"""Benchmark windows against brute force, by the set and by the join."""

from __future__ import annotations

import random
import re

import pytest

from refloom.llm import decontaminate
from tests.llm.brute import UPPER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, items string, spans int", "item_id long, text string, w int"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for at in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[at : at + k]), set()).add(str(i) if i is not None else None)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for at in range(len(w) - k + 1):
                if (g := tuple(w[at : at + k])) in grams:
                    hit.update(range(at, at + k))
                    found |= grams[g]
        out.append((d, len(w), len(hit), tuple(sorted(x for x in found if x is not None)), bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(5)
    draw = lambda n: [rng.choice("alpha beta gamma delta eps zeta Eta été 日本 x1".split()) for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([3, 9, 10, 11, 25])))) for i in range(12)] + [(99, "!!!"), (98, None), (None, "lone item here"), (97, "dup dup dup"), (97, "dup dup dup")]
    docs = [(i, " ".join(draw(rng.choice([0, 2, 30, 80])))) for i in range(40)]
    docs += [(100 + i, "Start, " + "-".join(items[i][1].upper().split()) + "; end.") for i in range(12)]
    docs += [(200, None), (201, ""), (202, "a lone item here b"), (203, "dup dup dup dup"), (203, "dup dup dup dup"), (None, "lone item here"), (204, "q " * 30000 + items[3][1])]
    return docs, items


@pytest.mark.parametrize(("set_windows", "broadcast"), [(50_000, 1), (0, 4_000_000), (0, 0)])
def test_hits(spark, monkeypatch, set_windows, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    docs, items = case()
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], DOCS)
    b = spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    got = decontaminate.judge(d, b, set_windows=set_windows).collect()
    want = brute(docs, items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str) == want
    clean = decontaminate.decontaminate(d, b, set_windows=set_windows)
    assert clean.columns == d.columns and sorted((r.doc_id for r in clean.collect()), key=str) == sorted((x[0] for x in want if not x[4]), key=str)


def test_spans_are_cut(spark):
    d = spark.createDataFrame([(1, "keep this, One Two three! and that", "c", 1), (2, "nothing", "c", 1), (3, None, "c", 1)], DOCS)
    b = spark.createDataFrame([(1, "one two three", 1)], ITEMS)
    text = {r.doc_id: r.text for r in decontaminate.cut_spans(d, b).collect()}
    assert text[2] == "nothing" and text[3] is None and words(text[1]) == ["keep", "this", "and", "that"]


def test_empty(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.judge(d, b).count() == 0
    assert decontaminate.judge(spark.createDataFrame([(1, "a b", "c", 1)], DOCS), b).first().n_hit == 0


@pytest.mark.parametrize("set_windows", [50_000, 0])
def test_clashing_columns_stay(spark, set_windows):
    schema = "doc_id long, text string, _hit int, content string, hit int, `row` string, w string"
    d = spark.createDataFrame([(1, "one two three four", 1, "c", 2, "r", "w"), (2, "five", 1, "c", 2, "r", "w")], schema)
    b = spark.createDataFrame([(1, "one two three", 1)], ITEMS)
    assert [tuple(r) for r in decontaminate.decontaminate(d, b, set_windows=set_windows).collect()] == [(2, "five", 1, "c", 2, "r", "w")]
    cut = decontaminate.cut_spans(d, b, set_windows=set_windows)
    assert cut.columns == d.columns and {r.doc_id: words(r.text) for r in cut.collect()} == {1: ["four"], 2: ["five"]}
