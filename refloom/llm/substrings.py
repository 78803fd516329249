"""Substring dedup by relative Lempel-Ziv parsing against all earlier documents.

A window of ``n`` words is a duplicate if its word sequence also starts in a
document with a smaller id.  Every document is factored greedily, left to right:
a factor refers to a place in one earlier document and is extended as long as
the words at the same distance from that place go on agreeing; where they stop,
the next factor begins.  Factors of at least ``n`` words are duplicate spans.
Windows that straddle the end of a factor, or that no factor reaches, may still
stand in some other document; those are checked one by one, so no window is
missed.  The words removed are those that the factors cover.

The reference is every document, held in blocks of some megabytes.  Factoring
each document against each block would be quadratic, so the index says which
places of the reference can matter.  Each window names its anchor, the 5-gram
of least hash in it; an anchor with up to 8 words on either side is its snippet,
and holds all windows of the anchor.

1. a block tells the index its anchors; the index answers those that stand in
   several documents, and whether their snippets differ;
2. for these the block sends its snippets with their first place; the index
   answers with the smallest id, and the place there: the reference;
3. the first holder of a snippet whose anchor has other snippets, and any snippet
   that has no reference, is at the end of factors: its windows are sent, and the
   index answers with the smallest id and place of each;
4. factors are parsed from these references.

Anchors, snippets and windows are index entries of their own, spread by their
hash, and a block sends each once, so a passage that many documents share costs
an entry for each block and never gathers in one task.  Rows travel packed, one
for each block and index partition.  Words are hashed to 64 bits; snippets and
windows are compared by two 64-bit hashes of their words.

Defined cases: null is an empty text without words; a null id sorts after every
id and never makes others duplicates; documents with equal ids do not affect each
other; texts of any length are one document, parsed some megabytes at a time with
others, and one text is never split; repeated rows each give a row; ids must be
of a whole-number type, others raise ``ValueError``; empty tables give empty
results; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, StructType

from refloom.llm.tokens import RangeHash, Words, mix64, words_of

WINDOW = 13
GRAM = 5
#: Bytes and documents in a block at most (on average), and bytes of text whose entries share an index partition.
BLOCK_BYTES = 2_000_000
BLOCK_DOCS = 1000
INDEX_BYTES = 8_000_000

_NO_ID = np.iinfo(np.int64).max
_PACKED = "part long, block long, n long, blob binary"
_ANSWER = "block long, n long, blob binary"
_FACTOR = StructType().add("first", "integer").add("last", "integer").add("ref", "long").add("ref_word", "integer")
_FIELDS = StructType().add("text", "string").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("factors", ArrayType(_FACTOR))


def _ids(column) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(_NO_ID), np.int64)


class _Parse:
    """Anchors and windows of some texts; places are word numbers."""

    def __init__(self, w: Words, ids: np.ndarray, n: int):
        count, grams = len(w.hash), n - GRAM + 1
        self.ids = ids[w.first_text + w.text_of] if count else np.zeros(0, np.int64)
        starts = np.arange(max(count - n + 1, 0))
        starts = starts[w.text_of[starts] == w.text_of[starts + n - 1]] if len(starts) else starts
        ranges = RangeHash(w.hash)
        if len(starts):
            at = np.arange(count - GRAM + 1)
            gram = ranges.of(at, at + GRAM)
            best, arg = gram[starts], np.zeros(len(starts), np.int64)
            for j in range(1, grams):
                here = gram[starts + j]
                less = here < best
                best, arg = np.where(less, here, best), np.where(less, j, arg)
            pick = starts + arg
        else:
            gram, pick = np.zeros(0, np.uint64), starts
        self.window, self.pick = starts, pick
        new = np.ones(len(pick), bool)
        new[1:] = pick[1:] != pick[:-1]
        self.place = pick[new]  # of each anchor occurrence
        self.of_window = np.cumsum(new) - 1  # window -> anchor occurrence
        text = w.text_of[self.place] if len(self.place) else self.place
        low = np.maximum(self.place - (grams - 1), w.first_word[text])
        high = np.minimum(self.place + n, w.first_word[text + 1])
        self.anchor = gram[self.place]
        self.snippet = mix64(ranges.of(low, high) + (self.place - low).astype(np.uint64))
        self.doc = self.ids[self.place]
        self.window_hash = ranges.of(starts, starts + n)


def _rows(part: np.ndarray, block: int, arrays: list[np.ndarray]) -> pa.Table:
    """Arrays packed into one row for each value of ``part``."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(part)] if len(part) else cut
    arrays = [a[order] for a in arrays]
    blobs = [b"".join(a[s:e].tobytes() for a in arrays) for s, e in zip(cut, ends, strict=True)]
    return pa.table(
        {
            "part": pa.array(part[cut].astype(np.int64)),
            "block": pa.array(np.full(len(cut), block, np.int64)),
            "n": pa.array((ends - cut).astype(np.int64)),
            "blob": pa.array(blobs, pa.binary()),
        }
    )


def _unpack(table: pa.Table, kinds: list) -> tuple[list[np.ndarray], np.ndarray]:
    """The packed arrays end to end, and the block of every entry."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    sizes = table["n"].to_pylist()
    for n, blob in zip(sizes, table["blob"], strict=True):
        at, buffer = 0, blob.as_buffer()
        for k, kind in enumerate(kinds):
            parts[k].append(np.frombuffer(buffer, kind, n, at))
            at += n * np.dtype(kind).itemsize
    blocks = np.repeat(np.asarray(table["block"], np.int64), sizes)
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True)], blocks


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by the keys, and the group number of each sorted entry."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _least(values: np.ndarray, group: np.ndarray, ufunc=np.minimum) -> np.ndarray:
    """The least value of each group (sorted groups), one per group."""
    return ufunc.reduceat(values, np.flatnonzero(np.r_[True, group[1:] != group[:-1]])) if len(values) else values


_U, _I, _N, _B = np.uint64, np.int64, np.int32, np.uint8
_SPOT = [_U, _U, _I, _N]  # two hashes, the id and the word number of a place


def _parsed(table: pa.Table, n: int):
    """The texts of a block, some at a time."""
    ids = _ids(table["id"])
    return ((w, _Parse(w, ids, n)) for w in words_of(table["text"]))


def _joined(found: list, kinds: list) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, k) for k in kinds]


def _firsts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group


def _send(key, parts: int, arrays: list[np.ndarray]) -> pa.Table:
    return _rows((arrays[0] % _U(parts)).astype(_I), key[0].as_py(), arrays)


def _reply(block: np.ndarray, arrays: list[np.ndarray]) -> pa.Table:
    out = _rows(block, 0, arrays)
    return pa.table({"block": out["part"], "n": out["n"], "blob": out["blob"]})


def _anchors(n: int, parts: int):
    """Each anchor of a block, one of its snippets, and whether it has several documents (1) or snippets (2) here."""

    def run(key, table):
        anchor, snippet, doc = _joined([(p.anchor, p.snippet, p.doc) for _, p in _parsed(table, n)], [_U, _U, _I])
        order, group = _groups(anchor, snippet)
        anchor, snippet, doc = anchor[order], snippet[order], doc[order]
        by_anchor = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])[: len(anchor)]
        first = _firsts(by_anchor)
        docs = _least(doc, by_anchor) != _least(doc, by_anchor, np.maximum)
        snippets = _least(group, by_anchor) != _least(group, by_anchor, np.maximum)
        return _send(key, parts, [anchor[first], snippet[first], docs.astype(_B) + 2 * snippets.astype(_B)])

    return run


def _shared_anchors(table):
    """The anchors that stand in several documents, with whether their snippets differ."""
    (anchor, snippet, flags), block = _unpack(table, [_U, _U, _B])
    order = np.argsort(anchor, kind="stable")
    anchor, snippet, flags, block = (x[order] for x in (anchor, snippet, flags, block))
    group = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])[: len(anchor)]
    size = np.bincount(group)[group] if len(group) else group
    flag = np.bitwise_or.reduceat(flags, _firsts(group))[group] if len(group) else flags
    differ = ((flag & 2) > 0) | (_least(snippet, group) != _least(snippet, group, np.maximum))[group]
    keep = (size > 1) | ((flag & 1) > 0)
    return _reply(block[keep], [anchor[keep], differ[keep].astype(_B)])


def _first_places(one: np.ndarray, other: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Of each pair of hashes the least (id, place), and whether several ids hold it."""
    order = np.lexsort((place, doc, other, one))
    one, other, doc, place = one[order], other[order], doc[order], place[order]
    group = np.cumsum(np.r_[False, (one[1:] != one[:-1]) | (other[1:] != other[:-1])])[: len(one)]
    first = _firsts(group)
    several = (doc[first] != _least(doc, group, np.maximum)).astype(_B)
    return [one[first], other[first], doc[first], place[first], several]


def _snippets(n: int, parts: int):
    """The snippets of a block whose anchor stands in several documents, each with its first place here."""

    def run(key, table, answers):
        anchor, differ = _answers(answers, 0, [_U, _B])
        found = []
        for w, p in _parsed(table, n):
            known, _ = _lookup((anchor, np.zeros_like(anchor)), [differ], (p.anchor, np.zeros_like(p.anchor)))
            place = (p.place - w.first_word[w.text_of[p.place]]).astype(_N) if len(p.place) else p.place.astype(_N)
            found.append((p.snippet[known], p.anchor[known], p.doc[known], place[known]))
        return _send(key, parts, _first_places(*_joined(found, _SPOT)))

    return run


def _windows(n: int, parts: int):
    """The windows of a block that stand at ends of factors: their anchor is shared in other snippets, their own has no reference."""

    def run(key, table, answers):
        anchor, differ = _answers(answers, 0, [_U, _B])
        snippet, anchor2, least, _ = _answers(answers, 1, _SPOT)
        found = []
        for w, p in _parsed(table, n):
            shared, (several,) = _lookup((anchor, np.zeros_like(anchor)), [differ], (p.anchor, np.zeros_like(p.anchor)))
            known, (low,) = _lookup((snippet, anchor2), [least], (p.snippet, p.anchor))
            wanted = (shared & (several > 0) & ~(known & (low < p.doc)))[p.of_window]
            place = (p.window - w.first_word[w.text_of[p.window]]).astype(_N) if len(p.window) else p.window.astype(_N)
            found.append((p.window_hash[wanted], p.anchor[p.of_window][wanted], p.doc[p.of_window][wanted], place[wanted]))
        return _send(key, parts, _first_places(*_joined(found, _SPOT)))

    return run


def _references(table):
    """The first place of each snippet or window that stands in several documents."""
    (one, other, doc, place, several), block = _unpack(table, [*_SPOT, _B])
    order = np.lexsort((place, doc, other, one))
    one, other, doc, place, several, block = (x[order] for x in (one, other, doc, place, several, block))
    group = np.cumsum(np.r_[False, (one[1:] != one[:-1]) | (other[1:] != other[:-1])])[: len(one)]
    first = _firsts(group)
    keep = ((doc[first] != _least(doc, group, np.maximum)) | (_least(several, group, np.maximum) > 0))[group]
    return _reply(block[keep], [one[keep], other[keep], doc[first][group][keep], place[first][group][keep]])


def _lookup(keys: tuple[np.ndarray, np.ndarray], values: list[np.ndarray], ask: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values at pairs of keys: (found, values)."""
    if not len(keys[0]) or not len(ask[0]):
        return np.zeros(len(ask[0]), bool), [np.zeros(len(ask[0]), v.dtype) for v in values]
    one, other = mix64(keys[0] + mix64(keys[1])), mix64(ask[0] + mix64(ask[1]))
    order = np.argsort(one)
    at = np.minimum(np.searchsorted(one[order], other), len(one) - 1)
    at = order[at]
    return (keys[0][at] == ask[0]) & (keys[1][at] == ask[1]), [v[at] for v in values]


def _answers(table: pa.Table, kind: int, kinds: list) -> list[np.ndarray]:
    table = table.filter(pa.compute.equal(table["kind"], kind)) if table.num_rows else table
    return _unpack(table, kinds)[0]


def factors(w: Words, p: _Parse, snippets: list[np.ndarray], windows: list[np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """The greedy parse of some texts: first word, last word, reference id and reference word of each factor.

    Word numbers count from the start of the slice.  The reference of a window is
    the place of its snippet, or else its own; a factor goes on while the next
    window's reference is one word further in the same document.
    """
    one, other, least, place = snippets
    known, (low, at) = _lookup((one, other), [least, place], (p.snippet, p.anchor))
    doc, start, anchor_at = p.doc[p.of_window], p.window, p.place[p.of_window]
    earlier = (known & (low < p.doc))[p.of_window]
    ref, shift = low[p.of_window], at[p.of_window].astype(_I) - anchor_at
    one, other, least, place = windows
    own, (wlow, wat) = _lookup((one, other), [least, place], (p.window_hash, p.anchor[p.of_window]))
    alone = own & (wlow < doc) & ~earlier
    ref, shift = np.where(alone, wlow, ref), np.where(alone, wat.astype(_I) - start, shift)
    hit = earlier | alone
    start, ref, shift = start[hit], ref[hit], shift[hit]
    text = w.text_of[start] if len(start) else start
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    last = start[np.r_[head[1:], len(start)] - 1] + n - 1 if len(start) else start
    first, ref, begin = start[head], ref[head], (start + shift)[head]
    long_enough = last - first + 1 >= n  # a single window is the shortest factor that counts
    return first[long_enough], last[long_enough], ref[long_enough], begin[long_enough]


def _cut(n: int, with_text: bool):
    """Factors, removed words and what is left of each document."""

    def run(key, table, answers):
        snippets, windows = _answers(answers, 1, _SPOT), _answers(answers, 2, _SPOT)
        n_words, n_removed, digests, spans, texts = [], [], [], [], []
        for w, p in _parsed(table, n):
            first, last, ref, begin = factors(w, p, snippets, windows, n)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            of: dict[int, list] = {}
            for f, e, r, b in zip(first.tolist(), last.tolist(), ref.tolist(), begin.tolist(), strict=True):
                t = int(w.text_of[f])
                base = int(w.first_word[t])
                of.setdefault(t, []).append({"first": f - base, "last": e - base, "ref": r, "ref_word": b})
            raw = w.data.tobytes()
            total = np.r_[0, np.cumsum(gone)]
            for t in range(len(w.text_start) - 1):
                a, b = int(w.first_word[t]), int(w.first_word[t + 1])
                body = raw[w.text_start[t] : w.text_start[t + 1]]
                removed = int(total[b] - total[a])
                words = body.split()
                if removed:
                    words = [words[i] for i in np.flatnonzero(~gone[a:b])]
                n_words.append(b - a)
                n_removed.append(removed)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                spans.append(of.get(t, []))
                if with_text:
                    if removed:
                        keep = np.ones(len(body), bool)
                        after = np.r_[w.start[a + 1 : b], w.text_start[t + 1]]
                        mark = np.zeros(len(body) + 1, np.int32)
                        mark[w.start[a:b][gone[a:b]] - w.text_start[t]] += 1
                        mark[after[gone[a:b]] - w.text_start[t]] -= 1
                        keep = np.cumsum(mark[:-1]) == 0
                        body = np.frombuffer(body, np.uint8)[keep].tobytes()
                    texts.append(body.decode("utf-8", "replace"))
        out = {"row": table["row"]}
        if with_text:
            out["text"] = pa.compute.if_else(table["text"].is_null().combine_chunks(), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
        out |= {
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
            "factors": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("ref", pa.int64()), ("ref_word", pa.int32())]))),
        }
        return pa.table(out)

    return run


def parse(docs: DataFrame, n: int = WINDOW, *, id_col: str = "doc_id", text_col: str = "text", cut: bool = True) -> DataFrame:
    """``row`` (a struct of the columns of ``docs`` but the text), text (cut), n_words, n_removed, kept_sha256, factors.

    factors are (first word, last word, reference id, reference word); with
    ``cut=False`` the text is left out.
    """
    if n < GRAM:
        raise ValueError(f"a window needs at least {GRAM} words")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"ids are compared: {id_col} must be of a whole-number type")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    text_bytes = size["bytes"] or 0
    blocks, parts = max(1, -(-text_bytes // BLOCK_BYTES), -(-size["n"] // BLOCK_DOCS)), max(1, -(-text_bytes // INDEX_BYTES))
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        # null and repeated ids spread by their texts
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).alias("block"),
    )
    by_block = kept.groupBy("block")
    told = lambda sent, index, kind: sent.groupBy("part").applyInArrow(index, _ANSWER).withColumn("kind", F.lit(kind))
    shared = told(by_block.applyInArrow(_anchors(n, parts), _PACKED), _shared_anchors, 0)
    places = told(by_block.cogroup(shared.groupBy("block")).applyInArrow(_snippets(n, parts), _PACKED), _references, 1)
    ends = shared.unionByName(places)
    windows = told(by_block.cogroup(ends.groupBy("block")).applyInArrow(_windows(n, parts), _PACKED), _references, 2)
    results = _FIELDS.fieldNames()[0 if cut else 1 :]
    schema = StructType([kept.schema["row"], *[_FIELDS[c] for c in results]])
    return by_block.cogroup(places.unionByName(windows).groupBy("block")).applyInArrow(_cut(n, cut), schema)

