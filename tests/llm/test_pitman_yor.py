"""Pitman-Yor scores: counts against brute force, and held-out likelihood."""

from __future__ import annotations

import math
import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from refloom.llm import pitman_yor
from refloom.llm.durable import shared_dir
from tests.llm.brute import SPACED, UPPER

SCHEMA = "doc_id long, text string, score double, id int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, 0.5, 1) for x in rows], SCHEMA)


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    follows = {w: rng.sample(vocabulary, 5) for w in vocabulary}
    rows = []
    for i in range(n):
        w, out = rng.choice(vocabulary), []
        for _ in range(rng.randrange(60)):
            out.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
            w = rng.choice(follows[w]) if rng.random() < 0.7 else rng.choice(vocabulary)
        rows.append((i, " ".join(out)))
    return rows + [(1001, None), (1002, ""), (1003, " \t\n"), (1004, "neverseen unheardof"), (None, "a null id"), (5, rows[5][1]), (1005, "long " * 20000)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def tokens(t):
    return [*SPACED.findall((t or "").translate(UPPER)), ""]


def test_counts_and_base_score(spark):
    rows = corpus()
    train = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted(
        (str(i), held(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5))
        for i, t in rows
    )
    got = pitman_yor.score(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_the_model_is_better_than_the_base_on_held_out_texts(spark):
    got = {r.held_out: r for r in pitman_yor.perplexity(pitman_yor.score(frame(spark, corpus(1500)))).collect()}
    assert got[True].perplexity < got[True].base_perplexity


def test_reruns_agree(spark):
    rows = corpus(80)
    run = lambda x: sorted((str(r.doc_id), round(r.score, 6)) for r in pitman_yor.score(frame(spark, x)).collect())
    assert run(rows) == run(rows[::-1])


def test_no_training_tokens_and_empty_table(spark):
    assert pitman_yor.score(frame(spark, [])).count() == 0
    only = next(i for i in range(1000) if held(i))
    row = pitman_yor.score(frame(spark, [(only, "all is new")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (4, 0, 0) and row.score < 0


def test_spelling_is_a_distribution():
    data = np.frombuffer(b"abcabd", np.uint8)
    cells, word = pitman_yor.spell(data, np.array([0, 3, 6]))
    assert len(cells) == 8 and word.tolist() == [0] * 4 + [1] * 4
    spelling = pitman_yor.Spelling(np.bincount(cells, minlength=257 * 257))
    assert np.allclose(np.exp(spelling.log_).sum(axis=1), 1.0, atol=1e-12)
    assert spelling.log(np.frombuffer(b"ab", np.uint8), np.array([0, 2, 2])).tolist() == pytest.approx([spelling.log_[256, 97] + spelling.log_[97, 98] + spelling.log_[98, 256], spelling.log_[256, 256]])


def model(spark, rows, parts=3):
    """The words, and in every context the probability of each word and of all that is spelled, by the trained model."""
    texts = spark.createDataFrame([(t or "",) for i, t in rows if not held(i)], "text string")
    table, heads, totals, spelling = pitman_yor.train(texts, parts)
    words, found = [], []
    for row in table.collect():
        blob = pa.scalar(bytes(row.blob), pa.binary())
        h, length, word, context, count, data = pitman_yor._read(blob, row.words, row.pairs)
        offsets = np.r_[0, np.cumsum(length.astype(np.int64))]
        raw = data.tobytes()
        spelled = np.exp(spelling.log(data, offsets))
        states = list(pitman_yor._states(7, row.part, word, context, count, spelled, totals[:-1]))
        words += [raw[s:e].decode() for s, e in zip(offsets, offsets[1:], strict=False)]
        found.append((states, word, context, count, spelled, [h[i] for i in range(len(h))]))
    samples = []
    for k in range(-pitman_yor.SAMPLES, 0):
        p, own = [], []
        for states, word, context, count, spelled, _ in found:
            base, extra = pitman_yor.predictive(states[k], totals[k], totals[0].d1, totals[0].d0, word, context, count, spelled)
            dense = np.zeros((len(heads) + 2, len(base)))
            dense[context, word] = extra
            p.append(base)
            own.append(dense)
        back = totals[k].back()
        given = np.concatenate(own, axis=1) + back[:, None] * np.concatenate(p)
        rest = back * totals[k].root() * (1 - np.concatenate([x[4] for x in found]).sum())
        samples.append((given, rest))
    hashes = {int(h): w for x, ws in zip(found, np.split(np.array(words, object), np.cumsum([len(x[5]) for x in found])[:-1]), strict=True) for h, w in zip(x[5], ws, strict=True)}
    contexts = {hashes[int(h)]: i + 2 for i, h in enumerate(heads)}
    return words, contexts, np.mean([s[0] for s in samples], axis=0), np.mean([s[1] for s in samples], axis=0), spelling, totals


def test_probabilities_sum_to_one_in_every_context(spark):
    _, contexts, given, rest, _, _ = model(spark, corpus())
    assert len(contexts) > 100 and np.allclose(given.sum(axis=1) + rest, 1.0, atol=1e-6)


def test_scores_are_the_sums_of_the_predictive_probabilities(spark, monkeypatch):
    rows = corpus(60)
    size = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(pitman_yor, "PART_BYTES", size // 3 + 1)
    words, contexts, given, _, spelling, totals = model(spark, rows, -(-size // (size // 3 + 1)))
    at = {w: i for i, w in enumerate(words)}
    root = np.mean([t.back() * t.root() for t in totals[-pitman_yor.SAMPLES :]], axis=0)

    def brute(text):
        total, before = 0.0, 1
        for w in tokens(text):
            raw = np.frombuffer(w.encode(), np.uint8)
            total += math.log10(given[before, at[w]] if w in at else root[before] * math.exp(spelling.log(raw, np.array([0, len(raw)]))[0]))
            before = contexts.get(w, 0)
        return total

    got = pitman_yor.score(frame(spark, rows)).collect()
    want = sorted((str(i), brute(t)) for i, t in rows)
    assert [x for x, _ in want] == [x for x, _ in sorted((str(r.doc_id), r.score) for r in got)]
    assert [x for _, x in sorted((str(r.doc_id), r.score) for r in got)] == pytest.approx([x for _, x in want], rel=1e-5, abs=1e-3)


def test_word_order_matters_to_the_model(spark):
    rows = corpus(1500)
    rng = random.Random(3)
    shuffled = [(i, " ".join(rng.sample(w, len(w)))) if held(i) and (w := SPACED.findall(t or "")) else (i, t) for i, t in rows]
    straight, mixed = ({r.held_out: r.perplexity for r in pitman_yor.perplexity(pitman_yor.score(frame(spark, x))).collect()}[True] for x in (rows, shuffled))
    assert straight < 0.7 * mixed


def test_tables_are_drawn_from_their_conditional():
    # two customers of a dish sit at one table or two: weights (1 - d) and (theta + d (others + 1)) p
    d, theta, p, others = 0.4, 2.0, 0.1, 5.0
    n = 40000
    got = pitman_yor.draw_tables(np.random.default_rng(1), np.full(n, 2.0), np.full(n, p), np.full(n, others), theta, d, pitman_yor.stirling(d))
    want = 1 + (two := (theta + d * (others + 1)) * p) / (two + 1 - d)
    assert abs(got.mean() - want) < 0.01
    table = np.exp(pitman_yor.stirling(d, 4))
    assert table[4, 1] == pytest.approx((1 - d) * (2 - d) * (3 - d)) and table[4, 4] == 1 and table[3, 2] == pytest.approx(3 * (1 - d))


def test_seating_gives_at_least_one_and_at_most_all_tables():
    rng = np.random.default_rng(2)
    customers = np.array([0.0, 1, 2, 50, 100000])
    tables = pitman_yor._seat(rng, customers, np.full(5, 3.0), 0.5)
    assert tables[0] == 0 and (tables[1:] >= 1).all() and (tables <= customers).all()


def test_counts_beyond_32_bits_are_kept():
    for big in (5, 2**32 - 1, 2**32, 2**32 + 5, 2**50):
        data = np.frombuffer(b"onetwo", np.uint8)
        bag = pitman_yor.Bag(np.array([1, 2, 2], np.uint64), np.array([0, 0, 7], np.uint16), np.array([big, 1, 2.0]), data, np.array([0, 3, 3]), np.array([3, 6, 6]))
        [(_, words, pairs, blob)] = bag.split(1)
        back = pitman_yor._read(pa.scalar(blob, pa.binary()), words, pairs)
        assert back[4].tolist() == [big, 1, 2] and back[0].tolist() == [1, 2] and back[5].tobytes() == b"onetwo"


def test_contexts_dealt_out_by_word_are_contexts_of_their_own(spark, monkeypatch):
    rows = corpus(300)
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 20_000)
    run = lambda **x: {(str(r.doc_id), r.n_tokens): r for r in pitman_yor.score(frame(spark, rows), **x).collect()}
    # without a sweep nothing is drawn: which contexts all tasks know makes no difference
    one, other = run(sweeps=0), run(sweeps=0, contexts_=5)
    assert {k: r.score for k, r in other.items()} == pytest.approx({k: r.score for k, r in one.items()}, rel=1e-5, abs=1e-3)
    # with sweeps other numbers are drawn for the same model: scores differ as those of two seeds do
    one, other = run(), run(contexts_=5)
    tokens_ = sum(r.n_tokens for r in one.values())
    assert max(abs(other[k].score - one[k].score) / k[1] for k in one if k[1] >= 10) < 0.1
    assert abs(sum(r.score for r in other.values()) - sum(r.score for r in one.values())) / tokens_ < 0.005


def test_blocks_are_scored_in_turns_and_only_scores_stay_on_disk(spark, monkeypatch):
    rows = corpus(300)
    monkeypatch.setattr(pitman_yor, "BLOCK_DOCS", 20)
    folder = shared_dir(spark).removeprefix("file:")
    run = lambda: sorted((str(r.doc_id), r.n_tokens, r.score) for r in pitman_yor.score(frame(spark, rows), contexts_=20).collect())
    before = set(os.listdir(folder))
    turns = run()
    assert sorted(x.partition("-")[0] for x in set(os.listdir(folder)) - before) == ["scored"] * pitman_yor.WAVES
    monkeypatch.setattr(pitman_yor, "WAVES", 1)
    assert run() == turns


def test_bags_of_a_part_are_merged_by_ranges():
    rng = np.random.default_rng(3)
    names = np.sort(rng.integers(1 << 16, 1 << 64, 20_000, np.uint64, endpoint=False))
    blobs = []
    for _ in range(20):
        word = rng.integers(0, len(names), 40_000)
        bag = pitman_yor.Bag(names[word], rng.integers(0, 3000, 40_000), np.ones(40_000), np.frombuffer(names.tobytes(), np.uint8), word * 8, word * 8 + 8)
        blobs += [(blob, words, pairs) for _, words, pairs, blob in bag.split(1)]
    pairs = sum(x[2] for x in blobs)
    found = []
    for ranges in (1, pitman_yor.RANGES):
        tracemalloc.start()
        found.append(pitman_yor._merge(lambda: (pitman_yor._read(*x) for x in blobs), ranges))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak < 80 * pairs  # 8 arrays of all pairs
    one, many = found
    for name in ("hash", "word", "context", "count", "data", "offsets"):
        assert np.array_equal(getattr(one, name), getattr(many, name))
    assert one.count.sum() == 20 * 40_000


def small_part():
    rng = np.random.default_rng(4)
    names = np.sort(rng.integers(1 << 16, 1 << 64, 60, np.uint64, endpoint=False))
    word, context = rng.integers(0, 60, 3000), rng.integers(0, 9, 3000)
    bag = pitman_yor.Bag(names[word], context, np.ones(3000), np.frombuffer(names.tobytes(), np.uint8), word * 8, word * 8 + 8)
    spelling = pitman_yor.Spelling(np.zeros(257 * 257))
    sums = np.array([len(bag.count), 60, 60, 5, 3, 2, 1], float)
    totals = [pitman_yor.Totals(np.bincount(context, minlength=9).astype(float), np.full(9, 30.0), sums) for _ in range(3)]
    return bag, spelling, totals


def test_a_sweep_goes_on_from_the_kept_state():
    bag, spelling, totals = small_part()
    spelled = np.exp(spelling.log(bag.data, bag.offsets))
    at_once = list(pitman_yor._states(7, 1, bag.word, bag.context, bag.count, spelled, totals))
    state = None
    for k, now in enumerate(totals):
        *_, state = pitman_yor._states(7, 1, bag.word, bag.context, bag.count, spelled, [now], (), 0, k, state)
        assert all(np.array_equal(x, y) for x, y in zip(state, at_once[k + 1], strict=True))


def test_the_model_of_a_part_is_handed_on_in_pieces(monkeypatch):
    bag, spelling, totals = small_part()
    [(part, words, pairs, blob)] = bag.split(1)
    batch = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([words]), pa.array([pairs]), pa.array([blob], pa.binary()), pa.array([None])], ["part", "words", "pairs", "blob", "told"])
    asked = (np.array([0], np.uint64), bag.hash[:5], np.full(5, 2, np.uint32), np.tile([3, 4], 5).astype(np.uint16))
    asks = pa.table({"block": [0], "words": [5], "pairs": [10], "blob": pa.array([b"".join(a.tobytes() for a in asked)], pa.binary())})
    told = []
    for size in (1 << 30, 100):
        monkeypatch.setattr(pitman_yor, "PIECE", size)
        rows = pa.Table.from_batches(pitman_yor._settle(totals[:1], spelling)(iter([batch])))
        assert max(len(x.as_py()) for x in rows["blob"]) <= size and (len(rows) > 1) == (size == 100)
        told.append(pitman_yor._tell(1)((pa.scalar(0),), rows.take(list(range(len(rows)))[::-1]), asks))
    assert told[0].equals(told[1])
