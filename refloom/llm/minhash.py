"""Near-duplicate documents by BagMinHash signatures of their word shingles.

A document is the multiset of its five-word shingles.  A shingle of weight w
owns a Poisson process over time x weight, discretised into the dyadic weight
intervals (0,1], (1,2], (2,4], ...: one process for each interval that begins
below w, of the interval's length as rate, whose points count only if their
weight mark is at most w.  A point falls on one of the registers, and a register
keeps its earliest point.  Points are drawn in order of time and a process stops
once it is past the latest register, so a document costs about one point for
each shingle.  Two registers agree with the probability of the weighted Jaccard
similarity.

Registers are banded, and equal texts are one node.  Nodes that share a bucket are
candidates; buckets with the very same nodes count once.  Similarity is estimated
from sketches, the SKETCH least element hashes of a text: for texts of up to that
many shingles the sketch is the whole multiset, and for longer ones a pair is
possible unless its sketches are SIGMAS standard errors below the threshold.
Links are found in two steps:

1. a maximum spanning forest of the possible pairs of each bucket, by estimated
   similarity, so that a group of copies costs about one pair for each member; its
   pairs are verified on the multisets themselves and joined into components;
2. every possible pair of nodes from *different* components that share a bucket is
   verified too, so that no link between components is lost, however estimates
   ranked it.  Buckets that are one chunk of whole sketches need no second step: there
   the forest was ranked by the similarities themselves, so it joins all that is linked.

Buckets of more than CHUNK nodes are split into chunks by a hash of node and
bucket.  In step 1 a chunk has a forest of its own; in step 2 the nodes outside a
bucket's largest component travel to each of its chunks, and are compared with it
some at a time.  So no task holds more than a chunk, and nothing is dropped.

Defined cases: null and wordless texts have no shingles and are alone in their
class, even among each other; a text of fewer than five words is one shingle; a
text of any length is one document; null ids are allowed and never name a class
with other ids; repeated rows are copies, and of equal ids the class has one;
empty tables give empty results; other columns are kept or ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.components import components
from refloom.llm.durable import durable, release
from refloom.llm.tokens import RangeHash, Words, mix64, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 4
#: Nodes of a bucket that one group holds (on average, where a bucket has more).
CHUNK = 512
#: Element hashes in a sketch.
SKETCH = 512
#: Pairs whose sketches are so many standard errors below the threshold are not
#: verified (a true link passes with probability > 0.9999).
SIGMAS = 4.0

#: Hashes that are compared at once.
_COLUMNS = 1 << 13

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the texts in ``w``: (text, hash, weight), sorted."""
    n = len(w.hash)
    ranges = RangeHash(w.hash)
    per_text = np.diff(w.first_word)
    place = np.arange(n)
    left = w.first_word[w.text_of + 1] - place if n else place
    first = place == w.first_word[w.text_of] if n else place.astype(bool)
    place = place[(left >= SHINGLE) | (first & (left > 0))]
    text = w.text_of[place] if n else place
    end = np.minimum(place + SHINGLE, w.first_word[text + 1]) if n else place
    value = ranges.of(place, end)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    assert len(per_text) == len(w.text_start) - 1
    return text[at], value[at], np.diff(np.r_[at, len(text)])


def registers(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m register times of weighted sets (inf: a text without elements)."""
    parts = []
    top = int(weight.max()) if len(weight) else 0
    level = 0
    while level == 0 or (1 << (level - 1)) < top:
        low = 0 if level == 0 else 1 << (level - 1)
        some = np.flatnonzero(weight > low)
        with np.errstate(over="ignore"):
            seeds = mix64(value[some] + _U(level) * _STEP)
        parts.append((text[some], seeds, weight[some], np.full(len(some), low), np.full(len(some), max(low, 1))))
        level += 1
    doc, seed, limit, low, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    times = np.full(texts * m, np.inf)
    now = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        with np.errstate(over="ignore"):
            a = mix64(seed + _U(2 * step) * _STEP)
            b = mix64(seed + _U(2 * step + 1) * _STEP)
        now = now - np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        mark = low + ((b >> _U(32)).astype(np.float64) + 0.5) * 2.0**-32 * length
        register = ((b & _U(0xFFFFFFFF)) * _U(m)) >> _U(32)
        counts = mark <= limit
        np.minimum.at(times, (doc * m + register.astype(np.int64))[counts], now[counts])
        latest = times.reshape(texts, m).max(axis=1)
        live = now < latest[doc]
        if not live.all():
            doc, seed, limit, low, length, now = doc[live], seed[live], limit[live], low[live], length[live], now[live]
    return times.reshape(texts, m)


def sketches(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The least element hashes of every text, sorted, end to end, and the offsets of the texts.

    The elements are the copies of the shingles, so that common elements over
    all elements are the weighted Jaccard similarity.
    """
    first = np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        h = mix64(np.repeat(value, weight) + (np.arange(len(first)) - first + 1).astype(_U) * _STEP) >> _U(32)
    of = np.repeat(text, weight).astype(np.int64)
    both = np.unique((of.astype(_U) << _U(32)) | h)
    of, h = (both >> _U(32)).astype(np.int64), (both & _U(0xFFFFFFFF)).astype(np.uint32)
    start = np.searchsorted(of, np.arange(texts))
    keep = np.arange(len(of)) - start[of] < SKETCH
    return h[keep], np.r_[0, np.cumsum(np.bincount(of[keep], minlength=texts))]


def _sketch(batches):
    """node, n and sketch of texts."""
    for batch in batches:
        for w in words_of(batch.column(1)):
            texts = len(w.text_start) - 1
            text, value, weight = shingles(w)
            h, offsets = sketches(text, value, weight, texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int32)))
            n = np.bincount(text, weight, texts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first_text, texts), pa.array(n), lists], ["node", "n", "sketch"])


def _sign(bands: int, rows: int):
    m = bands * rows

    def run(batches):
        for batch in batches:
            size, keys = [np.zeros(0, np.int64)], [np.zeros((0, bands), np.int64)]
            for w in words_of(batch.column(2)):
                texts = len(w.text_start) - 1
                text, value, weight = shingles(w)
                times = registers(text, value, weight, texts, m)
                sign = (mix64(times.view(_U)) >> _U(32)).astype(np.uint32)
                with np.errstate(over="ignore"):
                    band = sign.reshape(texts, bands, rows).astype(_U)
                    key = np.broadcast_to(np.arange(bands, dtype=_U), (texts, bands)).copy()
                    for r in range(rows):
                        key = mix64(key * _STEP + band[:, :, r])
                size.append(np.bincount(text, weight, texts).astype(np.int64))
                keys.append(key.view(np.int64))
            total = np.concatenate(size)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * bands), pa.array(np.concatenate(keys).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), lists], ["id", "node", "n", "keys"])

    return run


def _overlaps(batches):
    """Weighted Jaccard similarity of the two texts of each pair."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sides = []
            for column in (2, 3):
                found = [(t + w.first_text, v, c) for w in words_of(part.column(column)) for t, v, c in [shingles(w)]]
                sides.append([np.concatenate(x) for x in zip(*found, strict=True)])
            (ta, va, ca), (tb, vb, cb) = sides
            pair, value, count = np.r_[ta, tb], np.r_[va, vb], np.r_[ca, cb]
            order = np.lexsort((value, pair))
            pair, value, count = pair[order], value[order], count[order]
            same = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))
            low = np.bincount(pair[same], np.minimum(count[same], count[same + 1]), part.num_rows)
            total = np.bincount(pair, count, part.num_rows)
            similarity = low / np.maximum(total - low, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similarity)], ["a", "b", "similarity"])


class Sketches:
    """The sketches of some nodes, and the sizes of their multisets."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        column = table["sketch"].combine_chunks() if isinstance(table, pa.Table) else table["sketch"]
        self.values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
        self.offsets = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        self.n = np.asarray(table["n"], np.int64)

    def some(self, at: np.ndarray | slice) -> Sketches:
        out = object.__new__(Sketches)
        rows = np.arange(len(self.n))[at]
        out.values = np.concatenate([self.values[self.offsets[r] : self.offsets[r + 1]] for r in rows]) if len(rows) else self.values[:0]
        out.n, size = self.n[rows], np.diff(self.offsets)[rows]
        out.offsets = np.r_[0, np.cumsum(size)]
        return out


def similarities(x: Sketches, y: Sketches, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of each x and y, and whether sizes and sketches leave the threshold possible.

    Below the lesser of both sketches' ends, common hashes over all hashes
    estimate the similarity: a sample of the union without replacement, and the
    union itself where both sketches are whole.
    """
    _, inverse = np.unique(np.r_[x.values, y.values], return_inverse=True)
    left, right = inverse[: len(x.values)], inverse[len(x.values) :]
    size = int(inverse.max(initial=-1)) + 1
    shared, both = np.zeros(size, bool), np.zeros(size, bool)
    shared[left], both[right] = True, True
    shared &= both
    column, columns = np.cumsum(shared) - 1, int(shared.sum())
    row_x, row_y = (np.repeat(np.arange(len(s.n)), np.diff(s.offsets)) for s in (x, y))
    sides = [(row[shared[part]], column[part[shared[part]]], len(s.n)) for row, part, s in ((row_x, left, x), (row_y, right, y))]
    common = np.zeros((len(x.n), len(y.n)))
    for first in range(0, columns, _COLUMNS):
        dense = []
        for row, at, n in sides:
            here = (at >= first) & (at < first + _COLUMNS)
            block = np.zeros((n, min(_COLUMNS, columns - first)), np.float32)
            block[row[here], at[here] - first] = 1
            dense.append(block)
        common += dense[0] @ dense[1].T
    full = lambda s: np.diff(s.offsets) == SKETCH
    end = lambda s: np.where(full(s), s.values[np.maximum(s.offsets[1:] - 1, 0)].astype(np.int64) if len(s.values) else 0, np.int64(1 << 32))
    ends_x, ends_y = end(x), end(y)
    below = lambda s, ends: np.stack([np.searchsorted(s.values[a:b].astype(np.int64), ends, "right") for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)])
    either = np.minimum(below(x, ends_y), np.diff(x.offsets)[:, None]) + np.minimum(below(y, ends_x), np.diff(y.offsets)[:, None]).T - common
    nx, ny = x.n[:, None], y.n[None, :]
    whole = (nx + ny) / (1 + threshold)  # size of the union at the threshold
    error = np.sqrt(threshold * (1 - threshold) * np.maximum(0.0, 1 - either / whole) * either)
    error[~full(x)[:, None] & ~full(y)[None, :]] = 0.0
    possible = (common + 1e-6 >= threshold * either - SIGMAS * error) & (np.minimum(nx, ny) >= np.maximum(nx, ny) * threshold)
    return common / np.maximum(either, 1), possible


def _forest(sketch: Sketches, threshold: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of the possible pairs (Prim's way)."""
    value, possible = similarities(sketch, sketch, threshold)
    value[~possible] = -np.inf
    size, edges = len(value), []
    best, near, left = np.full(size, -np.inf), np.full(size, -1), np.ones(size, bool)
    for _ in range(size):
        at = int(np.argmax(np.where(left, best, -np.inf)))
        if best[at] == -np.inf or not left[at]:
            at = int(np.argmax(left))
        elif near[at] >= 0:
            edges.append((int(near[at]), at))
        left[at] = False
        better = left & (value[at] > best)
        best[better], near[better] = value[at][better], at
    return edges


def _pairs_of(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], ["a", "b"])


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return list(zip(first.tolist(), [*first[1:].tolist(), len(new)], strict=True)) if len(new) else []


def _forests(threshold: float):
    """Pairs (a, b) of the forests of the groups (key, chunk); a group may go on in the next batch."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        node, sketch, found = table["node"].to_pylist(), Sketches(table), []
        for s, e in _runs(np.asarray(table["key"], np.int64), np.asarray(table["chunk"], np.int64)):
            if e - s > 1:
                found += [(node[s + x], node[s + y]) for x, y in _forest(sketch.some(slice(s, e)), threshold)]
        return _pairs_of(found)

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            start = _runs(np.asarray(table["key"], np.int64), np.asarray(table["chunk"], np.int64))[-1][0] if table.num_rows else 0
            held = table.slice(start)
            if start:
                yield pairs(table.slice(0, start))
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


def _crossings(threshold: float):
    """Possible pairs (a, b) of a guest and a member of its group from different components.

    In a group the members come first; guests are compared with them as they come.
    """

    def run(batches):
        group, members = None, []
        for batch in batches:
            key, chunk, guest = (np.asarray(batch[c], np.int64) for c in ("key", "chunk", "guest"))
            for s, e in _runs(key, chunk, guest):
                here, part = (key[s], chunk[s]), batch.slice(s, e - s)
                members = members if here == group else []
                group = here
                if not guest[s]:
                    members.append(part)
                    continue
                if not members:
                    continue
                table = pa.Table.from_batches(members)
                node, label, main, sketch = table["node"].to_pylist(), table["label"].to_pylist(), table["main"][0].as_py(), Sketches(table)
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    names, labels = some["node"].to_pylist(), some["label"].to_pylist()
                    _, possible = similarities(Sketches(some), sketch, threshold)
                    # two guests meet in each other's chunk: once is enough
                    yield _pairs_of([(names[x], node[y]) for x, y in np.argwhere(possible).tolist() if labels[x] != label[y] and (label[y] == main or names[x] < node[y])])

    return run


def _grouped(rows: DataFrame, find, *order: str) -> DataFrame:
    """Distinct pairs (a, b) found inside the groups (key, chunk) of the rows."""
    at_hand = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", *order)
    return at_hand.mapInArrow(find, "a binary, b binary").distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, similarity) whose multisets reach the threshold."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = texts.join(nodes, "node", "left_semi")
    whole = pairs.join(wanted.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return whole.select("a", "b", "ta", "tb").mapInArrow(_overlaps, "a binary, b binary, similarity double").filter(F.col("similarity") >= threshold)


def classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    *,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, class_id (least id of its class), kept, node.

    ``kept`` marks the rows that stay if one text of each class stays.
    """
    node = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), node.alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = durable(docs.mapInArrow(_sign(bands, rows), f"id {kind}, node binary, n long, keys array<long>"), "every")
    ids = durable(every.select("id", "node"), "ids")
    signs = every.filter("n > 0").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.min("id").alias("holder"))
    signs = durable(signs, "signs")
    release(every)
    holder = signs.select("node", F.col("holder").alias("id"))

    members = signs.select("node", "holder", "n", F.explode("keys").alias("key"))
    prints = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"print{i}") for i in range(2)]
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.max("n").alias("most"), *prints).filter("size > 1")
    again = ((F.col("size") > CHUNK) | (F.col("most") >= SKETCH)).alias("again")
    sizes = sizes.groupBy("size", "most", "print0", "print1").agg(F.min("key").alias("key")).select("key", "size", again)  # buckets of the same nodes have the same pairs
    drawn = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("size") / CHUNK)).alias("chunk")
    shared = durable(members.join(sizes, "key").select("key", drawn, "size", "again", "node", "holder"), "shared")
    # the texts of all nodes that share a bucket, each once
    meet = shared.select(F.col("holder").alias("_id"), F.col("node").alias("_node")).distinct()
    texts = docs.join(meet, docs["id"].eqNullSafe(F.col("_id")) & (docs["node"] == F.col("_node")), "left_semi").dropDuplicates(["id", "node"])
    texts = durable(texts.select("node", "text"), "texts")
    sketched = durable(texts.select("node", "text").mapInArrow(_sketch, "node binary, n long, sketch array<int>"), "sketches")
    likely = durable(_grouped(shared.select("key", "chunk", "node").join(sketched, "node"), _forests(threshold)), "likely")
    parts = durable(components(verified(likely, texts, threshold).select("a", "b")), "parts")

    # possible pairs across components: what is outside a bucket's largest component against the whole bucket
    placed = shared.filter("again").drop("again", "holder").join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    largest = placed.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts"))
    placed = durable(placed.join(largest.filter("parts > 1").drop("parts"), "key"), "placed")
    guests = placed.filter(F.col("label") != F.col("main")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / CHUNK) - 1).cast("array<long>")))
    met = placed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1))).drop("size")
    across = durable(_grouped(met.join(sketched, "node"), _crossings(threshold), "guest"), "across")
    second = verified(across, texts, threshold)
    name = lambda x: parts.select(F.col("node").alias(x), F.col("label").alias("l" + x))
    joined = second.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(joined).select(F.col("node").alias("label"), F.col("label").alias("into"))
    nodes = holder.join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = nodes.join(merged, "label", "left").select("node", "id", F.coalesce("into", "label").alias("label"))
    wordless = ids.join(signs.select("node"), "node", "left_anti").select("id", "node", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    least = named.groupBy("label").agg(F.min("id").alias("class_id"))
    named = named.join(least, "label").select("node", "class_id", F.col("id").alias("holder"))
    rows_ = ids.join(named, "node").select("id", "node", "class_id", (F.col("id").eqNullSafe(F.col("class_id")) & F.col("holder").eqNullSafe(F.col("class_id"))).alias("kept"))
    return rows_.unionByName(wordless).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text", **signature) -> DataFrame:
    """The documents of ``docs`` that stay, one of each class, with all columns.

    Rows repeated under one id are one document: one of them stays.
    """
    kept = classes(docs, threshold, id_col=id_col, text_col=text_col, **signature).filter("kept").select(F.col(id_col).alias("id"), "node").distinct()
    node = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("of"), node.alias("of_node"))
    joined = marked.join(kept, F.col("of").eqNullSafe(F.col("id")) & (F.col("of_node") == F.col("node")), "left_semi")
    return joined.dropDuplicates(["of", "of_node"]).select("row.*")
