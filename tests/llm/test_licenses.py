"""License scans: phrases and the set-similarity join against all pairs."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from refloom.llm import licenses
from tests.llm.brute import UPPER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, label string, n int"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], DOCS)


def test_phrases(spark):
    rows = [(1, "The MIT License. mit-license; MIT\nlicense"), (2, "GNU general public license apache license"), (3, "mitlicense"), (4, None), (5, "mit license " * 30000), (6, "mit license"), (6, "mit license")]
    got = sorted(licenses.scan(frame(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_words, len(r.places), list(r.base_labels)) for r in got] == [(1, 7, 3, ["mit"]), (2, 6, 2, ["apache", "gpl"]), (3, 1, 0, []), (4, 0, 0, []), (5, 60000, 30000, ["mit"]), (6, 2, 1, ["mit"]), (6, 2, 1, ["mit"])]
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in got)


def test_empty(spark):
    assert licenses.scan(frame(spark, [])).count() == 0
    assert licenses.scan(frame(spark, [(1, "mit license")]), spark.createDataFrame([], "label string, text string")).first().score == 1.0


def test_notices_wrapped_over_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    far = "Redistribution and use in source and binary forms\n" + "x " * 20 + "\nwith or without modification, are permitted"
    rows = [(1, "Copyright (c) The Regents.\n" + bsd), (2, " * " + bsd.replace("\n", "\r\n * ")), (3, far), (4, "Licensed\nunder\nCC\n\nBY-NC\n4.0"), (4, None), (None, bsd)]
    got = sorted((str(r.doc_id), list(r.labels), r.score) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == sorted([("1", ["bsd"], 1.0), ("2", ["bsd"], 1.0), ("3", [], 0.0), ("4", ["cc-by-nc"], 1.0), ("4", [], 0.0), ("None", ["bsd"], 1.0)])


def test_words_of_a_notice_far_apart_are_none(spark):
    far = " x ".join("y " * 2000 + w for w in "released under the mit license".split())
    rows = [(1, far), (2, "under the hill the mit students released a song"), (3, "it is released under the mit licence."), (4, "word " * 9000 + "licensed under cc by-nc 4.0")]
    got = {r.doc_id: (list(r.labels), r.score) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: ([], 0.0), 2: ([], 0.0), 3: (["mit"], 0.8), 4: (["cc-by-nc"], 1.0)}


@pytest.mark.parametrize("small", [True, False])
def test_every_window_that_fits(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(licenses, "SET_WORDS", 0)
    rng = random.Random(5)
    pool = [f"k{i}" for i in range(9)]
    templates = [(f"l{i}", " ".join(rng.choices(pool, k=rng.choice([1, 3, 6])))) for i in range(12)]
    templates += [("none", "--"), ("l0", "k1 k1 k2")]
    docs = [(i, rng.choice(["\n", " "]).join(" ".join(rng.choices([*pool, "o", "K3"], k=rng.randrange(4))) for _ in range(rng.randrange(6)))) for i in range(80)] + [(100, None), (101, ""), (5, "k1")]
    got = licenses.fitting_windows(frame(spark, docs), spark.createDataFrame(templates, "label string, text string"), 0.8, small=small)
    got = got.join(frame(spark, docs).select("doc_id", licenses.content_key("text")), "content").select("doc_id", "label", F.round("containment", 9)).distinct()
    want = set()
    for d, t in docs:
        for label, template in templates:
            w, n, s = words(t), len(words(template)), set(words(template))
            o = max([len(s & set(w[i : i + n])) for i in range(len(w))], default=0)
            if s and o >= math.ceil(len(s) * 0.8 - 1e-9):
                want.add((d, label, round(o / len(s), 9)))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
