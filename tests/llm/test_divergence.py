"""Source divergence against plain counting with Python's whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from refloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *x, "clash", 1) for i, x in enumerate(rows)], SCHEMA)


def brute(rows, least=10, top=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(w for w, n in docs[lang].items() if n >= least)
        whole = Counter({w: sum(count[lang, s][w] for s in sources) for w in kept})
        n = {s: sum(count[lang, s][w] for w in kept) for s in sources}
        p = {s: {w: 1 + 10**9 * (count[lang, s][w] + 2) // (n[s] + 2 * len(kept)) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (whole[w] + 2) // (sum(n.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if count[lang, s][w] > 0 and p[s][w] > q[w])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)}
    return out


def found(spark, rows, **more):
    df = divergence.audit(frame(spark, rows), **more)
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(rng, n):
    words = ["alpha", "alp", "al", "beta", "été", "étés", "zebra", "Ünder", "日本", "日", "co" * 30, "a", "be", "\U0001f600", "ﬁn"]
    rows = [(" ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(n)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("once upon", "yy", "p"), ("twice", "yy", "r"), ("x" * 100_000 + " 1alpha2alpha", "en", "a")]
    return rows + rows[:40]  # repeated rows are documents of their own


@pytest.mark.parametrize(("terms", "counters", "block", "cells"), [(400_000, 1_000_000, 2048, 1 << 20), (50, 20, 3, 4)])
def test_all_cases(spark, monkeypatch, terms, counters, block, cells):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "COUNTERS", counters)
    monkeypatch.setattr(divergence, "BLOCK", block)
    audit = divergence._audit
    monkeypatch.setattr(divergence, "_audit", lambda top: audit(top, cells))
    rows = corpus(random.Random(5), 400)
    assert found(spark, rows) == brute(rows)


def test_few_candidates_and_ties(spark):
    rows = [(" ".join(f"w{chr(97 + k)}" for k in range(20)), "en", "a")] * 12 + [("other words", "en", "b")] * 12
    got = found(spark, rows)
    assert got == brute(rows)
    assert [x[3] for x in sorted((r for r in got if r[1:3] == ("a", "term")), key=lambda r: r[5])] == [f"w{chr(97 + k)}" for k in range(10)]


def test_hot_source(spark):
    rng = random.Random(9)
    rows = corpus(rng, 60) + [("alpha beta gamma", "en", "hot")] * 3000
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, None, None)]) == set()
    assert found(spark, [(None, None, None), ("x", None, "b")]) == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


def test_tries_merge_in_byte_order():
    rng = random.Random(1)
    plain, tables = defaultdict(lambda: [0, Counter()]), []
    for _ in range(7):
        rows = defaultdict(lambda: [0, Counter()])
        for _ in range(300):
            key, source, n = (rng.choice(["de", "en"]), "".join(rng.choice("abé日") for _ in range(rng.randint(1, 4)))), rng.choice("xy"), rng.randint(1, 9)
            for leaf in (rows[key], plain[key]):
                leaf[0] += 1
                leaf[1][source] += n
        ordered = sorted(rows.items(), key=lambda r: (r[0][0].encode(), r[0][1].encode()))
        tables.append([(lang, t, d, sorted(c), [c[x] for x in sorted(c)]) for (lang, t), (d, c) in ordered])
    stream = sorted((r for t in tables for r in t), key=lambda r: (r[0].encode(), r[1].encode()))
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*stream[k : k + 9], strict=True), divergence._LEAF, strict=True)], schema=divergence._LEAF) for k in range(0, len(stream), 9)]
    got = [tuple(r.values()) for t in divergence._merged(batches, 3) for r in t.to_pylist()]
    want = [(lang, t, d, sorted(c), [c[x] for x in sorted(c)]) for (lang, t), (d, c) in sorted(plain.items(), key=lambda r: (r[0][0].encode(), r[0][1].encode())) if d >= 3]
    assert got == want


def test_front_coding_is_undone_by_the_traversal():
    terms = sorted({"a", "ab", "abc", "b", "é", "éa", "日本", "日"}, key=str.encode)
    shared, rest = divergence.front_coded([t.encode() for t in terms])
    assert list(divergence.traversed(shared, rest)) == terms and sum(map(len, rest)) < sum(len(t.encode()) for t in terms)


def test_shares_are_whole_for_large_counts():
    for count, total, kept in ((10**15, 4 * 10**15, 7), (0, 5, 1), (5, 5, 1), (123_456_789_012, 987_654_321_098_765, 10**9)):
        assert divergence.share(np.array([count]), np.array([total]), kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)
    with pytest.raises(OverflowError):
        divergence.share(np.array([1]), np.array([10**16]), 1)
