"""Scoring texts with a hierarchical Pitman-Yor language model.

Tokens are white-space separated words, A-Z lower-cased, and an end token, which
is the empty word.  Restaurants form a hierarchy:

* a restaurant for each context, the word before or the start of a text;
* all of them share one parent, the context-free restaurant of words;
* its base spells a word byte by byte, each byte given the one before, with the
  frequencies of the distinct training words, so every byte string has a
  probability and nothing is out of vocabulary.

Customers are seated by the Chinese restaurant process: a dish's customers join
tables in proportion to size - d or open one in proportion to (theta + d tables)
times the parent's probability, and each table is a customer of the parent.  The
state is the number of tables of each dish in each restaurant.  A Gibbs sweep
draws it anew for every dish from its conditional given the customers, the
parent's probability and the tables of all other dishes (in the totals of the
sweep before): a generalised Stirling number of customers and tables, times
probability and strength for every table.  Dishes of more than ``EXACT`` customers
are seated in growing groups instead.  Seatings go on from sweep to sweep: each
part keeps its state for the next sweep, and the last ones for the average.  All tasks know the totals of the ``CONTEXTS`` most frequent
words as contexts; those of the others are held by the parts of these words, which
after each sweep add up what all parts send and tell each part what it asks for.  Probabilities are averaged over the last ``SAMPLES`` states;
in each state they use the totals of that same state, so that they sum to one over
all words in every context.

Words live in hashed parts, so no context or word gathers in one task beyond its
own distinct entries.  What tasks share is bounded: totals of CONTEXTS + 2
restaurants for each sweep and 257 x 257 byte pairs.  Of a context dealt out by word
tables change only where a pair occurs more than once, so only those are sent anew.  Word counts themselves are
never broadcast: blocks of documents ask the parts for the words they hold, in
``WAVES`` turns, so that what is asked and told is on disk for a share of the blocks at a time.

Defined cases: a null text is empty and has only its end token; a null id is in
training; repeated rows count each; texts of any length are scored whole, some
megabytes at a time with others; with no training tokens the model is its base;
an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.durable import LARGE, TIDY, durable, release, settings
from refloom.llm.tokens import RangeHash, mix64, trimmed, words_of

#: Strengths of the context restaurants and of the words'; their discounts are
#: estimated from all counts, n1 / (n1 + 2 n2).
S1, S0 = 20.0, 10.0
#: So many contexts, the most frequent, have their totals known to all tasks; those of the others are dealt out by word.
CONTEXTS = 4096
#: Sweeps of the sampler, and how many of the last states are averaged.
SWEEPS = 4
SAMPLES = 3
#: Customers of a dish up to which its tables are drawn from the exact conditional.
EXACT = 128
BLOCK_BYTES = 4_000_000
BLOCK_DOCS = 4096
PART_BYTES = 8_000_000
#: The model of a part is handed on in pieces of so many bytes.
PIECE = 250_000
#: Ranges of hashes by which the bags of a part are merged.
RANGES = 4
#: Turns in which blocks are scored, at most, of this many blocks at least.
WAVES, WAVE_BLOCKS = 3, 4

_U, _I = np.uint64, np.int64
_STOP = 256  # end of word, and what stands before a word
_SIDE = 257
#: Numbers of two contexts: the start of a text, and, where 16 bits are kept, any that is known by its hash.
_RARE, _START = 0, 1
#: Senders of what a part has for itself: sums of its words as contexts, and its state.
_OWN, _STATE = -1, -2
#: Contexts that all tasks know have numbers below this, the others are hashes beyond it.
_HASHED = 1 << 16


def _hash(h: np.ndarray) -> np.ndarray:
    """Hashes of words, none of which looks like the number of a context."""
    return np.where(h < _U(_HASHED), h + _U(_HASHED), h)


def _dealt(context: np.ndarray) -> np.ndarray:
    """Which contexts are known by their hash and dealt out by word."""
    return (context < 0) | (context >= _HASHED)


def _pack(context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as how many are dealt out, 16 bits of each, and the hashes of those dealt out."""
    dealt = _dealt(context)
    return np.array([dealt.sum()], _U), np.where(dealt, _RARE, context).astype(np.uint16), context[dealt]


def _unpack(short: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    context = short.astype(_I)
    if len(hashes):
        context[short == _RARE] = hashes
    return context


def stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [customers, tables]."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    tables = np.arange(size + 1)
    for c in range(size):
        stay = np.log(np.maximum(c - tables * discount, 1e-300)) + out[c]
        stay[(tables == 0) | (tables > c)] = -np.inf
        out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c, :-1]])
    return out


def _seat(rng, customers, attraction, discount):
    """Tables after seating each dish's customers in groups; attraction is (theta + d tables) x parent."""
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    done = 1.0
    while len(live):
        group = max(1.0, np.floor(done / 16))
        n = np.minimum(customers[live] - done, group)
        a = attraction[live]
        p = a / (a + done - discount * np.minimum(tables[live], done))
        tables[live] += rng.binomial(n.astype(_I), np.clip(p, 0.0, 1.0))
        done += group
        live = live[customers[live] > done]
    return tables


def draw_tables(rng, customers: np.ndarray, parent: np.ndarray, others: np.ndarray, strength: float, discount: float, table: np.ndarray) -> np.ndarray:
    """A draw of the tables of each dish given its customers, the parent's probability and the other dishes' tables."""
    out = np.minimum(customers, 1.0)
    toss = np.zeros(len(customers))
    toss[customers > 1] = rng.random((customers > 1).sum())
    many = np.flatnonzero(customers > EXACT)
    out[many] = _seat(rng, customers[many], (strength + discount * others[many]) * parent[many], discount)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    bounds = np.flatnonzero(np.r_[True, np.diff(customers[few]) > 0]) if len(few) else few
    for s, e in zip(bounds, np.r_[bounds[1:], len(few)] if len(few) else bounds, strict=True):
        c = int(customers[few[s]])
        step = max(1, 1_000_000 // c)
        for at in range(s, e, step):
            some = few[at : min(at + step, e)]
            opened = np.log(strength + discount * (others[some][:, None] + np.arange(c))) + np.log(parent[some])[:, None]
            weight = np.cumsum(opened, axis=1) + table[c, 1 : c + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1.0 + (weight < (toss[some] * weight[:, -1])[:, None]).sum(axis=1)
    return out


class Spelling:
    """Words byte by byte, each given the byte before it; made from counts of byte pairs."""

    def __init__(self, pairs: np.ndarray):
        counts = pairs.reshape(_SIDE, _SIDE) + 1.0
        self.log_ = np.log(counts / counts.sum(axis=1, keepdims=True))

    def log(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log probabilities of the words data[offsets[i]:offsets[i+1]]."""
        cell, word = spell(data, offsets)
        return np.bincount(word, self.log_.ravel()[cell], len(offsets) - 1)


def spell(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of the words, the closing one included, and the word of each."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    word = np.repeat(np.arange(n), length + 1)
    symbol = np.full(len(word), _STOP, _I)
    ends = np.cumsum(length + 1) - 1
    inside = np.ones(len(word), bool)
    inside[ends] = False
    symbol[inside] = data
    before = np.full(len(word), _STOP, _I)
    before[1:] = symbol[:-1]
    return before * _SIDE + symbol, word


def _tokens(texts: pa.Array, heads: np.ndarray):
    """Slices of texts as (first text, text, hash, context, start, end, data), the end tokens last.

    ``heads`` are the sorted hashes of the words that are contexts by number, others are by hash.
    """
    known = pd.Index(heads)
    end = _hash(RangeHash(np.zeros(0, _U)).of(np.zeros(1, _I), np.zeros(1, _I)))
    for w in words_of(texts, lower=True):
        n = len(w.text_start) - 1
        hashes = _hash(w.hash)
        own = hashes.view(_I)
        at = known.get_indexer(hashes)
        own = np.where(at >= 0, at + 2, own)
        context = np.full(len(own), _START, _I)
        context[1:] = own[:-1]
        filled = np.diff(w.first_word) > 0
        context[w.first_word[:-1][filled]] = _START
        final = np.full(n, _START, _I)
        final[filled] = own[w.first_word[1:][filled] - 1]
        zero = np.zeros(n, _I)
        yield (
            w.first_text,
            np.r_[w.text_of, np.arange(n)],
            np.r_[hashes, np.repeat(end, n)],
            np.r_[context, final],
            np.r_[w.start, zero],
            np.r_[w.end, zero],
            w.data,
        )


def _lean(work):
    """The same work on batches, after which nothing that was freed stays with the worker."""

    def run(batches):
        yield from work(batches)
        trimmed()

    return run


def _count_words(batches):
    """Counts of the words of a batch, the end token left out."""
    for batch in batches:
        found = [(np.zeros(0, _U), np.zeros(0, _I))]
        for w in words_of(batch.column(0), lower=True):
            code, h = pd.factorize(_hash(w.hash))
            found.append((h, np.bincount(code, minlength=len(h))))
        code, h = pd.factorize(np.concatenate([x[0] for x in found]))
        n = np.bincount(code, np.concatenate([x[1] for x in found]), len(h))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(_I)), pa.array(n.astype(_I))], ["word", "n"])


def contexts(texts: DataFrame, size: int) -> tuple[np.ndarray, bool]:
    """Sorted hashes of the ``size`` most frequent words, and whether there are more."""
    words = texts.mapInArrow(_lean(_count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = words.orderBy(F.desc("n"), "word").limit(size + 1).collect()
    return np.sort(np.array([r["word"] for r in found[:size]], _I).view(_U)), len(found) > size


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of data end to end, with their offsets."""
    length = end - start
    offsets = np.r_[0, np.cumsum(length)]
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, length)
    return data[index], offsets


def _ranked(values: np.ndarray, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in the order of their parts, then their own, and which of them each value is."""
    code, names = pd.factorize(values)  # only distinct values are compared
    order = np.argsort(names) if parts == 1 else np.lexsort((names, names % _U(parts)))
    rank = np.empty(len(names), _I)
    rank[order] = np.arange(len(names))
    return names[order], rank[code]


def _distinct(hashes: np.ndarray, context: np.ndarray, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by part, hash and context, places of the first of each group, and group of each sorted entry."""
    place = _ranked(hashes, parts)[1]
    names, code = _ranked(context)
    place *= len(names)
    place += code
    order = np.argsort(place)
    place = place[order]
    new = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


class Bag:
    """Words (sorted by hash, with bytes) and counts of their (word, context) pairs."""

    def __init__(self, hashes, context, count, data, start, end):
        order, first, group = _distinct(hashes, context)
        self.count = np.bincount(group, count[order], len(first)).astype(np.float64)
        picked = order[first]
        hashes, self.context = hashes[picked], context[picked].astype(_I)
        new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        self.word = np.cumsum(new) - 1
        self.hash = hashes[new]
        self.data, self.offsets = _gather(data, start[picked][new], end[picked][new])

    @classmethod
    def joined(cls, bags: Sequence[Bag]) -> Bag:
        """Bags of ascending ranges of hashes as one."""
        out = cls.__new__(cls)
        for name in ("count", "context", "hash", "data"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in bags]))
        words, size = (np.cumsum([0] + [len(getattr(x, k)) for x in bags]) for k in ("hash", "data"))
        out.word = np.concatenate([x.word + n for x, n in zip(bags, words, strict=False)])
        out.offsets = np.r_[0, np.concatenate([x.offsets[1:] + n for x, n in zip(bags, size, strict=False)])]
        return out

    def split(self, parts: int):
        """(part, words, pairs, blob) of the words of each part; counts take 32 bits, or 64 where one of them needs it."""
        kind = _U if self.count.max(initial=0) >= 2**32 else np.uint32
        per_word = np.bincount(self.word, minlength=len(self.hash))
        hashes, context, count, data, offsets = self.hash, self.context, self.count, self.data, self.offsets
        pairs = np.r_[0, np.cumsum(per_word)]
        part = np.zeros(len(hashes), _I)
        if parts > 1:  # all is put in the order of the parts once, each of which is then a range
            part = (hashes % _U(parts)).astype(_I)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            data, offsets = _gather(data, offsets[order], offsets[order + 1])
            moved, _ = _gather(np.arange(len(context)), pairs[order], pairs[order + 1])
            part, hashes, per_word, context, count = part[order], hashes[order], per_word[order], context[moved], count[moved]
            pairs = np.r_[0, np.cumsum(per_word)]
        length = np.diff(offsets).astype(np.uint32)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
        for s, e in zip(cut, np.r_[cut[1:], len(part)], strict=False):
            n_dealt, short, dealt = _pack(context[pairs[s] : pairs[e]])
            counts = count[pairs[s] : pairs[e]].astype(kind)
            arrays = (np.array([kind is _U], _U), n_dealt, hashes[s:e], length[s:e], per_word[s:e].astype(np.uint32), short, dealt, counts, data[offsets[s] : offsets[e]])
            yield int(part[s]), int(e - s), len(counts), b"".join(a.tobytes() for a in arrays)


def _read(blob, words: int, pairs: int):
    """hash, length, word of each pair, context, count, bytes."""
    buffer, at, out = blob if isinstance(blob, bytes) else blob.as_buffer(), 16, []
    wide, dealt = (int(x) for x in np.frombuffer(buffer, _U, 2))
    for kind, n in ((_U, words), (np.uint32, words), (np.uint32, words), (np.uint16, pairs), (_I, dealt), (_U if wide else np.uint32, pairs)):
        out.append(np.frombuffer(buffer, kind, n, at))
        at += n * np.dtype(kind).itemsize
    h, length, per_word, short, hashes, count = out
    data = np.frombuffer(buffer, np.uint8, -1, at) if at < len(memoryview(buffer)) else np.zeros(0, np.uint8)
    return h, length, np.repeat(np.arange(words), per_word), _unpack(short, hashes), count.astype(np.float64), data


def _fields(buffer, *kinds) -> list[np.ndarray]:
    """Arrays of (type, length) that stand one after the other, after the number of contexts dealt out, for which -1 stands."""
    dealt, at, out = int(np.frombuffer(buffer, _U, 1)[0]), 8, []
    for kind, n in kinds:
        n = dealt if n < 0 else n
        out.append(np.frombuffer(buffer, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_BAGS = "part long, words long, pairs long, blob binary"


def _bags(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.table(
        {"part": pa.array([r[0] for r in rows], pa.int64()), "words": pa.array([r[1] for r in rows], pa.int64()), "pairs": pa.array([r[2] for r in rows], pa.int64()), "blob": pa.array([r[3] for r in rows], pa.binary())}
    )


def _merge(bags: Callable[[], Iterable[tuple]], ranges: int = 1) -> Bag:
    """One bag of many (hash, length, word, context, count, data), made by ranges of hashes so that one range is unpacked at a time."""
    bounds, made = [_U(i * 2**64 // ranges) for i in range(ranges)], []
    for i, low in enumerate(bounds):
        found, base = [], 0
        for h, length, word, context, count, data in bags():
            first, last = np.searchsorted(h, low), np.searchsorted(h, bounds[i + 1]) if i + 1 < ranges else len(h)
            pairs, offsets = slice(*np.searchsorted(word, (first, last))), np.r_[0, np.cumsum(length.astype(_I))]
            at, start = word[pairs], base - offsets[first]
            found.append((h[at], context[pairs].copy(), count[pairs].copy(), data[offsets[first] : offsets[last]], offsets[at] + start, offsets[at + 1] + start))
            base += offsets[last] - offsets[first]
        columns = [list(x) for x in zip(*found, strict=True)] or [[np.zeros(0, k)] for k in (_U, _I, _I, np.uint8, _I, _I)]
        del found
        made.append(Bag(*(np.concatenate(columns.pop(0)) for _ in range(6))))
    return made[0] if ranges == 1 else Bag.joined(made)


def _count(parts: int, heads: np.ndarray):
    """The bag of each batch of texts; slices are packed by part at once, so that only one part is unpacked at a time."""

    def work(batches):
        for batch in batches:
            held: dict[int, list] = {}
            for _, _, h, context, start, end, data in _tokens(batch.column(0), heads):
                for part, words, pairs, blob in Bag(h, context, np.ones(len(h)), data, start, end).split(parts):
                    held.setdefault(part, []).append((blob, words, pairs))
            for part in sorted(held):
                blobs = held.pop(part)
                bag = _merge(lambda: (_read(*x) for x in blobs))  # noqa: B023
                yield from _bags((part, *rest) for _, *rest in bag.split(1)).to_batches()

    return _lean(work)


def _part(key, table):
    rows = list(zip(table["blob"], table["words"].to_pylist(), table["pairs"].to_pylist(), strict=True))
    bag = _merge(lambda: (_read(*x) for x in rows), RANGES)
    return _bags(bag.split(1)).set_column(0, "part", pa.array([key[0].as_py()], pa.int64())) if len(bag.hash) else _bags([])


class Totals:
    """What the tasks know of a state: customers and tables of every context, and of the words' restaurant."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, words: np.ndarray):
        self.customers, self.tables = customers, tables
        self.all_customers, self.all_tables, self.words = words[0], words[1], words[2]
        self.d1, self.d0 = ((one + 0.5) / (one + 2 * two + 1.0) for one, two in (words[3:5], words[5:7]))

    def back(self) -> np.ndarray:
        """The share of each context that goes to its parent."""
        return (S1 + self.d1 * self.tables) / (S1 + self.customers)

    def root(self) -> float:
        """The share of the words' restaurant that goes to the spelling."""
        return (S0 + self.d0 * self.all_tables) / (S0 + self.all_customers)


def _states(seed: int, part: int, word, context, count, spelled, totals: Sequence[Totals], told: Sequence[np.ndarray] = (), single=0, after: int = 0, state=None):
    """The states of a part's words: (tables of pairs, customers of words, tables of words), one more than totals.

    ``told`` are for each of the totals the tables of the contexts that are dealt out, by pair;
    ``single`` the number of each word's pairs that occur once and are not listed: they have one table each;
    ``state`` that after so many sweeps, from which these go on.
    """
    n = len(spelled)
    t1, c0, t0 = state or (np.ones(len(count)), np.bincount(word, minlength=n).astype(float) + single, np.ones(n))
    yield t1, c0, t0
    if not totals:
        return
    d1, d0 = totals[0].d1, totals[0].d0
    low, high = stirling(d1), stirling(d0)
    dealt = _dealt(context)
    number = np.where(dealt, _RARE, context)
    for k, now in enumerate(totals):
        rng = np.random.default_rng([seed, after + k, part])
        p = (np.maximum(c0 - d0 * t0, 0) + (S0 + d0 * now.all_tables) * spelled) / (S0 + now.all_customers)
        tables = now.tables[number]
        if len(told):
            tables[dealt] = told[k]
        t1 = draw_tables(rng, count, p[word], tables - t1, S1, d1, low)
        c0 = np.bincount(word, t1, n) + single
        t0 = draw_tables(rng, c0, spelled, now.all_tables - t0, S0, d0, high)
        yield t1, c0, t0


#: Sums of a state, what parts send to the parts of contexts (4), and the state itself (5).
_SUMS = "kind int, cell long, value double, sender long, blob binary"


def _sent(part: int, parts: int, state: int, context, count, tables):
    """(to, blob) for the parts of contexts: their tables here at first, later those beyond one a pair; and which are asked for."""
    some = _dealt(context) & ((count > 1) | (state == 0))
    names, at = _ranked(context[some])
    value = np.bincount(at, tables[some] - (state > 0), len(names)).astype(_I)
    asked = np.bincount(at, count[some] > 1, len(names)) > 0
    to = (names.view(_U) % _U(parts)).astype(_I)
    for p in np.unique(to):
        own = to == p
        yield int(p), np.array([own.sum()], _I).tobytes() + names[own].tobytes() + value[own].tobytes() + asked[own].tobytes()


_TELLS = "part long, sender long, blob binary"


def _add(key, table):
    """Sums of what all parts sent: to each what it asks for, in its order, and all with their names for the part itself (sender -1)."""
    got = []
    for blob in table["blob"]:
        buffer = blob.as_buffer()
        n = int(np.frombuffer(buffer, _I, 1)[0])
        got.append((np.frombuffer(buffer, _I, n, 8), np.frombuffer(buffer, _I, n, 8 + 8 * n), np.frombuffer(buffer, bool, n, 8 + 16 * n)))
    names, at = _ranked(np.concatenate([x[0] for x in got]))
    sums = np.zeros(len(names), _I)
    np.add.at(sums, at, np.concatenate([x[1] for x in got]))
    me = key[0].as_py()
    rows, s = [(me, _OWN, names.tobytes() + sums.tobytes())], 0
    for sender, (n, _, asked) in zip(table["sender"].to_pylist(), got, strict=True):
        rows.append((sender, me, sums[at[s : s + len(n)][asked]].tobytes()))
        s += len(n)
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("part", pa.int64()), ("sender", pa.int64()), ("blob", pa.binary())))})


def _pair_tables(told: list, parts: int, context, count) -> list[np.ndarray]:
    """By state: the tables of the context of each pair whose context is dealt out (0 where nothing is drawn)."""
    here = context[_dealt(context)]
    asked = np.unique(context[_dealt(context) & (count > 1)])
    order = np.argsort(asked.view(_U) % _U(parts), kind="stable")  # replies come by sender
    out = []
    for k in sorted({x["state"] for x in told if x["sender"] >= 0}):
        value = np.zeros(len(asked))
        replies = sorted((x for x in told if x["state"] == k and x["sender"] >= 0), key=lambda x: x["sender"])
        value[order] = np.concatenate([np.frombuffer(x["blob"], _I) for x in replies]) if len(asked) else 0
        value += out[0] if k else 0
        out.append(value)
    at = np.searchsorted(asked, here)
    drawn = np.isin(here, asked)
    found = []
    for value in out:
        found.append(np.zeros(len(here)))
        found[-1][drawn] = value[at[drawn]]
    return found


def _word_tables(told: list, h, states: int) -> np.ndarray:
    """By state: the tables of each word of a part as a context, where it is dealt out."""
    out = np.zeros((states, len(h)))
    for x in told:
        if x["sender"] == _OWN:
            names, sums = np.frombuffer(x["blob"], _I).reshape(2, -1)
            out[x["state"], np.searchsorted(h, names.view(_U))] = sums
    out[1:] += out[0]
    return out


def _held(told: list, state: int, words: int, pairs: int):
    """The state of a part after so many sweeps, as it was kept; None at the beginning."""
    for x in told:
        if x["sender"] == _STATE and x["state"] == state:
            return tuple(np.frombuffer(x["blob"], float, n, 8 * at) for n, at in ((pairs, 0), (words, pairs), (words, pairs + words)))
    return None


def _sums(part: int, sums, sent, state=()) -> pa.RecordBatch:
    sent = [*sent, *([(part, b"".join(x.tobytes() for x in state))] if state else [])]
    kind = np.concatenate([*[np.full(len(c), k, np.int32) for k, c, _ in sums], np.full(len(sent), 4, np.int32)])
    kind[len(kind) - bool(state) :] = 5
    cell = np.concatenate([*[c for _, c, _ in sums], np.array([to for to, _ in sent], _I)]).astype(_I)
    value = np.concatenate([*[v for _, _, v in sums], np.zeros(len(sent))]).astype(float)
    blobs = [None] * (len(kind) - len(sent)) + [b for _, b in sent]
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(cell), pa.array(value), pa.array(np.full(len(kind), part, _I)), pa.array(blobs, pa.binary())], ["kind", "cell", "value", "sender", "blob"])


def _begin(size: int, parts: int):
    """Sums of the first state, one table a pair: customers (0) and tables (1) of contexts, the words' restaurant (2), byte pairs (3)."""

    def work(batches):
        for batch in batches:
            for part, words, pairs, blob in zip(*(batch.column(i) for i in range(4)), strict=True):
                _, length, word, context, count, data = _read(blob, words.as_py(), pairs.as_py())
                number, c0 = np.where(_dealt(context), _RARE, context), np.bincount(word, minlength=len(length))
                n = np.bincount(spell(data, np.r_[0, np.cumsum(length.astype(_I))])[0], minlength=_SIDE * _SIDE)
                cells = np.flatnonzero(n)
                sums = [
                    (0, np.arange(size), np.bincount(number, count, size)),
                    (1, np.arange(size), np.bincount(number, minlength=size)),
                    (2, np.arange(7), np.array([c0.sum(), len(length), len(length), *((x == k).sum() for x in (count, c0) for k in (1, 2))], float)),
                    (3, cells, n[cells]),
                ]
                yield _sums(part.as_py(), sums, _sent(part.as_py(), parts, 0, context, count, np.ones(len(count))))

    return _lean(work)


def _thin(spelling: Spelling):
    """What sweeps need: per word what its spelling gives and its pairs that occur once, and the other pairs."""

    def work(batches):
        for batch in batches:
            for part, words, pairs, blob in zip(*(batch.column(i) for i in range(4)), strict=True):
                _, length, word, context, count, data = _read(blob, words.as_py(), pairs.as_py())
                spelled, many, n = np.exp(spelling.log(data, np.r_[0, np.cumsum(length.astype(_I))])), count > 1, len(length)
                n_dealt, short, dealt = _pack(context[many])
                arrays = (n_dealt, spelled, *(np.bincount(word[x], minlength=n).astype(np.uint32) for x in (~many, many)), short, dealt, count[many])
                yield from _bags([(part.as_py(), n, int(many.sum()), b"".join(a.tobytes() for a in arrays))]).to_batches()

    return _lean(work)


def _sweep(seed: int, sweep: int, now: Totals, size: int, parts: int):
    """The state after one more sweep (5) and its sums: tables of contexts beyond one a pair (1), the words' restaurant (2)."""

    def work(batches):
        for batch in batches:
            for part, words, pairs, blob, told in zip(*(batch.column(i) for i in range(5)), strict=True):
                n, m, part = words.as_py(), pairs.as_py(), part.as_py()
                spelled, single, per_word, short, dealt, count = _fields(blob.as_buffer(), (np.float64, n), (np.uint32, n), (np.uint32, n), (np.uint16, m), (_I, -1), (np.float64, m))
                context, word = _unpack(short, dealt), np.repeat(np.arange(n), per_word)
                told = told.as_py() or []
                tables, state = _pair_tables(told, parts, context, count), _held(told, sweep, n, m)
                *_, (t1, c0, t0) = _states(seed, part, word, context, count, spelled, [now], tables[-1:], single, sweep, state)
                sums = [(1, np.arange(size), np.bincount(np.where(_dealt(context), _RARE, context), t1 - 1, size)), (2, np.arange(7), np.array([c0.sum(), t0.sum(), n, 0, 0, 0, 0], float))]
                yield _sums(part, sums, _sent(part, parts, sweep + 1, context, count, t1), (t1, c0, t0))

    return _lean(work)


def predictive(state, now: Totals, d1: float, d0: float, word, context, count, spelled) -> tuple[np.ndarray, np.ndarray]:
    """Of a state: P(word), and what P(word | context) has beyond the parent's share."""
    p, own = _shares(state, now, d1, d0, count, spelled)
    return p, own / (S1 + now.customers[context])


def _shares(state, now: Totals, d1: float, d0: float, count, spelled) -> tuple[np.ndarray, np.ndarray]:
    """P(word), and what a pair keeps of its customers."""
    t1, c0, t0 = state
    return (np.maximum(c0 - d0 * t0, 0) + (S0 + d0 * now.all_tables) * spelled) / (S0 + now.all_customers), np.maximum(count - d1 * t1, 0)


def _settle(totals: Sequence[Totals], spelling: Spelling):
    """Per word: hash, count, P(word) and its parent's share as a context in each sample; per pair: word, context, customers kept on average."""

    def work(batches):
        d1, d0 = totals[0].d1, totals[0].d0
        samples = range(len(totals))[-SAMPLES:]
        for batch in batches:
            for part, words, pairs, blob, told in zip(*(batch.column(i) for i in range(5)), strict=True):
                h, length, word, context, count, data = _read(blob, words.as_py(), pairs.as_py())
                spelled = np.exp(spelling.log(data, np.r_[0, np.cumsum(length.astype(_I))]))
                told = told.as_py() or []
                per_word, many = np.bincount(word, minlength=len(h)), count > 1
                kept, ps = np.zeros(len(count)), np.zeros((len(samples), len(h)), np.float32)
                for i, k in enumerate(samples):
                    t1, (some, c0, t0) = np.ones(len(count)), _held(told, k, len(h), int(many.sum())) or (1.0, per_word, np.ones(len(h)))
                    t1[many] = some
                    ps[i], own = _shares((t1, c0, t0), totals[k], d1, d0, count, spelled)
                    kept += own
                kept /= len(samples)
                seen = np.bincount(word, count, len(h))
                back = ((S1 + d1 * _word_tables(told, h, len(totals))[-SAMPLES:]) / (S1 + seen)).astype(np.float32)
                n_dealt, short, dealt = _pack(context)
                arrays = (n_dealt, h, seen.astype(_I), ps, back, per_word.astype(np.uint32), short, dealt, kept.astype(np.float32))
                blob = b"".join(a.tobytes() for a in arrays)
                for at in range(0, len(blob), PIECE):
                    yield from _bags([(part.as_py(), len(h), len(word), blob[at : at + PIECE])]).append_column("at", pa.array([at], pa.int64())).to_batches()

    return _lean(work)


_ASKS = "part long, block long, words long, pairs long, blob binary"


def _pairs(texts, parts: int, heads: np.ndarray):
    """Distinct (word, context) pairs of a block, by part, what each token is, and where its word stands."""
    found = [(h, context, (text + first).astype(np.int32), (data, start.astype(np.int32), end.astype(np.int32))) for first, text, h, context, start, end, data in _tokens(texts, heads)]
    h, context, text = (np.concatenate([x[i] for x in found]) for i in range(3))
    found = [x[3] for x in found]
    order, first, group = _distinct(h, context, parts)
    of = np.empty(len(order), _I)
    of[order] = group
    return found, h[order[first]], context[order[first]], order[first], of, text


def _ask(parts: int, heads: np.ndarray):
    def work(key, table):
        found = [(h, context) for _, _, h, context, *_ in _tokens(table["text"], heads)]
        h, context = (np.concatenate([x[i] for x in found]) for i in range(2))
        del found
        order, first, _ = _distinct(h, context, parts)
        h, context = h[order[first]], context[order[first]]
        part = (h % _U(parts)).astype(_I)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = []
        for s, e in zip(cut, np.r_[cut[1:], len(h)], strict=True):
            new = np.r_[True, h[s + 1 : e] != h[s : e - 1]]
            words = h[s:e][new]
            per_word = np.diff(np.r_[np.flatnonzero(new), e - s]).astype(np.uint32)
            n_dealt, short, dealt = _pack(context[s:e])
            rows.append((int(part[s]), len(words), int(e - s), b"".join(a.tobytes() for a in (n_dealt, words, per_word, short, dealt))))
        out = _bags(rows)
        return out.add_column(1, "block", pa.array([key[0].as_py()] * len(rows), pa.int64()))

    return lambda key, table: trimmed(work(key, table))


_TOLD = "part long, block long, words long, pairs long, blob binary"


def _tell(samples: int):
    """What each pair asked for keeps; of each word the count (0: not in training), P(word), and its parent's share as a context."""

    def work(key, model, asks):
        h, count, ps, back, word, context, kept = np.zeros(0, _U), np.zeros(0, _I), np.zeros((samples, 0), np.float32), np.zeros((samples, 0), np.float32), np.zeros(0, _I), np.zeros(0, _I), np.zeros(0, np.float32)
        if model.num_rows:
            words, pairs = (model[x][0].as_py() for x in ("words", "pairs"))
            blob = b"".join(x.as_buffer() for x in model.sort_by("at")["blob"])
            kinds = (_U, words), (_I, words), (np.float32, words * samples), (np.float32, words * samples), (np.uint32, words), (np.uint16, pairs), (_I, -1), (np.float32, pairs)
            h, count, ps, back, per_word, short, dealt, kept = _fields(blob, *kinds)
            ps, back = ps.reshape(samples, words), back.reshape(samples, words)
            word, context = np.repeat(np.arange(words), per_word), _unpack(short, dealt)
        names, pair = _ranked(context)
        pair += word * len(names)
        at_name = pd.Index(names)
        rows = []
        for block, words, pairs, blob in zip(asks["block"].to_pylist(), asks["words"].to_pylist(), asks["pairs"].to_pylist(), asks["blob"], strict=True):
            wanted, per_word, short, dealt = _fields(blob.as_buffer(), (_U, words), (np.uint32, words), (np.uint16, pairs), (_I, -1))
            value, seen, p, b = np.zeros(pairs, np.float32), np.zeros(words, _I), np.zeros((samples, words), np.float32), np.ones((samples, words), np.float32)
            if len(h):
                asked = _unpack(short, dealt)
                at = np.minimum(np.searchsorted(h, wanted), len(h) - 1)
                known = h[at] == wanted
                seen, p, b = np.where(known, count[at], 0), np.where(known, ps[:, at], p), np.where(known, back[:, at], b)
                name = at_name.get_indexer(asked)
                ask = np.repeat(at, per_word) * len(names) + name
                place = np.minimum(np.searchsorted(pair, ask), len(pair) - 1)
                value = np.where((pair[place] == ask) & (name >= 0) & np.repeat(known, per_word), kept[place], value)
            rows.append((key[0].as_py(), block, words, pairs, b"".join(a.tobytes() for a in (value, seen, p, b))))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("part", pa.int64()), ("block", pa.int64()), ("words", pa.int64()), ("pairs", pa.int64()), ("blob", pa.binary())))})

    return lambda key, model, asks: trimmed(work(key, model, asks))


def _score(parts: int, heads: np.ndarray, totals: Sequence[Totals], spelling: Spelling):
    samples = totals[-SAMPLES:]
    shares, roots = np.stack([t.back() for t in samples]), np.array([t.root() for t in samples])
    n_train, n_distinct = float(samples[0].customers.sum()), samples[0].words
    floor = np.log10(n_train + 0.1 * (n_distinct + 1))

    def work(key, table, told):
        found, h, context, sample, of, text = _pairs(table["text"], parts, heads)
        order = np.argsort(np.asarray(told["part"], _I))
        got = []
        blobs, words, pairs = told["blob"], told["words"].to_pylist(), told["pairs"].to_pylist()
        for i in order:
            buffer, n, w = blobs[int(i)].as_buffer(), pairs[i], words[i]
            sides = np.frombuffer(buffer, np.float32, 2 * w * len(samples), 4 * n + 8 * w).reshape(2, len(samples), w)
            got.append((np.frombuffer(buffer, np.float32, n), np.frombuffer(buffer, _I, w, 4 * n), sides))
        kept, seen, sides = (np.concatenate(x, axis=-1) for x in zip(*got, strict=True))
        new = np.r_[True, h[1:] != h[:-1]]
        word = np.cumsum(new) - 1
        # a context that is dealt out is a word of the block
        dealt = _dealt(context)
        number, by_hash = np.where(dealt, _RARE, context), np.argsort(h[new])
        names, at = _ranked(context[dealt].view(_U))
        at = by_hash[np.searchsorted(h[new][by_hash], names)][at]
        customers = samples[0].customers[number]
        customers[dealt] = seen[at]
        # words that training lacks are spelled here
        bases = np.cumsum([0] + [len(start) for _, start, _ in found])
        unknown = np.flatnonzero(seen[word] == 0)
        chance, spelled = np.zeros(len(h)), np.zeros(len(unknown))
        for share, root, p, own in zip(shares, roots, *sides, strict=True):  # one sample is spread over the pairs at a time
            back = share[number]
            back[dealt] = own[at]
            chance += back * p[word]
            spelled += back[unknown] * root
        chance = kept / (S1 + customers) + chance / len(samples)
        chance[unknown] = spelled / len(samples)
        value = np.log10(chance)
        slot = np.searchsorted(bases, sample[unknown], "right") - 1
        for s in np.unique(slot):
            some = unknown[slot == s]
            at = sample[some] - bases[s]
            data, start, end = found[s]
            data, offsets = _gather(data, start[at], end[at])
            value[some] += spelling.log(data, offsets) / np.log(10)
        n, seen = table.num_rows, seen[word]
        base = np.log10(seen + 0.1) - floor
        return pa.table(
            {
                "id": table["id"],
                "held_out": table["held_out"],
                "n_tokens": pa.array(np.bincount(text, minlength=n).astype(_I)),
                "n_known": pa.array(np.bincount(text, seen[of] > 0, n).astype(_I)),
                "train_tokens": pa.array(np.full(n, int(n_train), _I)),
                "base_score": pa.array(np.bincount(text, base[of], n)),
                "score": pa.array(np.bincount(text, value[of], n)),
            }
        )

    return lambda key, table, told: trimmed(work(key, table, told))


def held_out(id_col: str):
    """Whether a document is kept from training: crc32 of its id, modulo 10, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def train(texts: DataFrame, parts: int, *, contexts_: int = CONTEXTS, sweeps: int = SWEEPS, seed: int = 7) -> tuple[DataFrame, np.ndarray, list[Totals], Spelling]:
    """The words in parts with what these are told, the words that are contexts by number, the totals of all states, and the spelling."""
    heads, more = contexts(texts, contexts_)
    bags = texts.mapInArrow(_count(parts, heads), _BAGS)
    words = durable(bags.groupBy("part").applyInArrow(lambda key, table: trimmed(_part(key, table)), _BAGS), "words", TIDY, file_rows=1)
    size, totals, outs, tells = len(heads) + 2, [], {}, {}
    nothing = F.lit(None).cast("array<struct<state:int,sender:long,blob:binary>>").alias("told")

    def with_told(df: DataFrame, rows: Sequence[DataFrame]) -> DataFrame:
        return df.join(reduce(DataFrame.unionByName, rows).groupBy("part").agg(F.collect_list("x").alias("told")), "part", "left") if rows else df.select("*", nothing)

    def known(states: Iterable[int], side: str) -> list[DataFrame]:
        """What parts are told of the first state and of these, and these states themselves."""
        kept = [outs[k].filter("kind = 5").select(F.col("sender").alias("part"), F.struct(F.lit(k).alias("state"), F.lit(_STATE).cast("long").alias("sender"), "blob").alias("x")) for k in states if k in outs]
        return [tells[k].filter(side) for k in sorted({0, *states}) if k in tells] + kept

    for k in range(sweeps + 1):
        # between sweeps parts only need what they asked for, not the names of all contexts
        out = words.mapInArrow(_begin(size, parts), _SUMS) if k == 0 else with_told(thin, known([k - 1], "x.sender >= 0")).mapInArrow(_sweep(seed, k - 1, totals[-1], size, parts), _SUMS)
        out = durable(out, "sweep", TIDY | LARGE)
        with settings(words.sparkSession, TIDY):
            got = out.filter("kind < 4").groupBy("kind", "cell").agg(F.sum("value").alias("value")).toPandas()  # two numbers for each context by number, and the byte pairs
        pick = lambda kind, n: np.bincount(got.cell[got.kind == kind], got.value[got.kind == kind], n)  # noqa: B023, E731
        if k == 0:
            customers, tables, spelling = pick(0, size), pick(1, size), Spelling(pick(3, _SIDE * _SIDE))
            thin = durable(words.mapInArrow(_thin(spelling), _BAGS), "thin", TIDY | LARGE, file_rows=1) if sweeps else None
        totals.append(Totals(customers, tables if k == 0 else tables + pick(1, size), pick(2, 7)))
        totals[k].d1, totals[k].d0 = totals[0].d1, totals[0].d0
        if more:
            now = durable(out.filter("kind = 4").select(F.col("cell").alias("to"), "sender", "blob").groupBy("to").applyInArrow(_add, _TELLS), "told", TIDY)
            tells[k] = now.select("part", F.struct(F.lit(k).alias("state"), "sender", "blob").alias("x"))
        # the last states are averaged; of the others the next sweep needs the last, and what was told of the first
        outs[k] = out
        for old in [k - 1] if 0 < k - 1 <= sweeps - SAMPLES else []:
            for table in (outs.pop(old), *([tells.pop(old)] if more else [])):
                release(table)
        if k == 0:
            release(outs.pop(0))
    if sweeps:
        release(thin)
    return with_told(words, known(range(max(0, sweeps + 1 - SAMPLES), sweeps + 1), f"x.sender = {_OWN}")), heads, totals, spelling


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", contexts_: int = CONTEXTS, sweeps: int = SWEEPS, seed: int = 7) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(id_col).alias("held_out"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    size = total["bytes"] or 0
    blocks, parts = max(1, -(-size // BLOCK_BYTES), -(-total["n"] // BLOCK_DOCS)), max(1, -(-size // PART_BYTES))
    model, heads, totals, spelling = train(rows.filter(~F.col("held_out")).select("text"), parts, contexts_=contexts_, sweeps=sweeps, seed=seed)
    settled = durable(model.mapInArrow(_settle(totals, spelling), _BAGS + ", at long"), "model", TIDY | LARGE)
    release(model)
    # null and repeated ids spread by their texts
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    waves, scored = max(1, min(WAVES, blocks // WAVE_BLOCKS)), []
    for wave in range(waves):
        by_block = rows.filter(F.col("block") % waves == wave).groupBy("block")
        asks = by_block.applyInArrow(_ask(parts, heads), _ASKS)
        told = settled.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(_tell(len(totals[-SAMPLES:])), _TOLD)
        scored.append(durable(by_block.cogroup(told.groupBy("block")).applyInArrow(_score(parts, heads, totals, spelling), schema), "scored", TIDY))
    release(settled)
    return reduce(DataFrame.unionByName, scored).withColumnRenamed("id", id_col)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of the model and of the unigram base, by held_out."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
