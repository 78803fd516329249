"""Source divergence audit: how the sources of a language differ in their terms.

Terms are counted in radix tries over UTF-8 bytes whose leaves hold one counter for
each source.  A trie is held as the sequence of its leaves in the order of their bytes,
in columns: two tries are merged by merging the sequences, and the nodes between root
and leaf are the prefixes that neighbours share.

1. every task counts the terms of its documents in one trie and sends it, leaf by leaf,
   whenever it holds ``COUNTERS`` counters;
2. Spark range-partitions the leaves by language and term, so that each task gets a
   range of prefixes of all tries in order, and merges equal leaves as they stream by;
   terms of too few documents go, the rest is written in blocks of ``BLOCK`` terms, each
   as the length of the prefix shared with the term before and the bytes after it;
3. each block meets the totals of its language's sources.  Its traversal adds to the
   divergence of every pair of sources, terms of count 0 included, and keeps for each
   source its ``TOP`` most over-used terms, ties in UTF-8 order;
4. sums and candidates of all blocks are merged and ranked.

All arithmetic is in whole numbers: a term's share is 1 + floor(10^9 (count + 2) /
(N + 2 V)), the divergence floor((p - q)^2 / (p + q)).

Defined cases: null text, lang and source are empty strings; a source without terms is a
group with counts 0; a language with one source has no pairs, one without kept terms
has pairs of value 0 and no term rows; repeated rows are documents of their own; texts
of any length are read whole; ties go to the item first in UTF-8 order; an empty table
gives an empty result; other columns are ignored, whatever their names.  The pair part
has the square of a language's sources in rows; it is the result's size that bounds the
sources, none is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.durable import durable, release

#: Fixed value: letters of A-Z, a-z and whatever lies beyond ASCII, in lower-cased UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms that are counted at a time, counters in a task's trie before it is sent, terms in a block, candidates of a group.
TERMS = 400_000
COUNTERS = 1_000_000
BLOCK = 2048
TOP = 10
MIN_DOCUMENTS = 10

_I = np.int64


def _counters(terms: list[bytes], document: np.ndarray, group: np.ndarray) -> pa.Table:
    """(group, term, count, documents) of terms, given the document of each and the group of each document."""
    coded = pa.array(terms, pa.large_binary()).dictionary_encode()
    term, width = np.asarray(coded.indices, _I), len(coded.dictionary)
    keys, count = np.unique(group[document] * width + term, return_counts=True)
    once = np.unique(document * width + term)
    _, documents = np.unique(group[once // width] * width + once % width, return_counts=True)
    return pa.table({"group": keys // width, "term": coded.dictionary.take(pa.array(keys % width)), "count": count, "documents": documents})


_LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("documents", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _changes(*columns) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first one does."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1))) for c in columns])
    return np.flatnonzero(new)


def _leaves(counters: pa.Table) -> pa.Table:
    """The trie of counters (lang, term, source, count, documents): one leaf a term, in UTF-8 order."""
    merged = counters.group_by(["lang", "term", "source"]).aggregate([("count", "sum"), ("documents", "sum")])
    merged = merged.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]).combine_chunks()
    lang, term, source, count, documents = (merged[c].combine_chunks() for c in ("lang", "term", "source", "count_sum", "documents_sum"))
    starts = _changes(lang, term)
    if not len(starts):
        return _LEAF.empty_table()
    ends = pa.array(np.append(starts, len(lang)), pa.int32())
    first = pa.array(starts)
    columns = [lang.take(first), term.take(first), pa.array(np.add.reduceat(np.asarray(documents), starts)), pa.ListArray.from_arrays(ends, source), pa.ListArray.from_arrays(ends, count)]
    return pa.table([c.cast(f.type) for c, f in zip(columns, _LEAF, strict=True)], schema=_LEAF)


def _count(batches):
    """The trie of a task's documents (lang, source, text), sent as leaves."""
    groups: dict[tuple, int] = {}
    held: list[pa.Table] = []

    def sent() -> Iterator[pa.RecordBatch]:
        if held:
            every = pa.concat_tables(held)
            names = list(groups)
            at = every["group"].combine_chunks()
            lang, source = (pa.array([x[i] for x in names], pa.string()).take(at) for i in (0, 1))
            term = every["term"].cast(pa.large_string()).cast(pa.string())
            yield from _leaves(pa.table({"lang": lang, "term": term, "source": source, "count": every["count"], "documents": every["documents"]})).to_batches(20_000)
            held.clear()

    for batch in batches:
        owner = [groups.setdefault(x, len(groups)) for x in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)]
        terms, sizes, own = [], [], []
        for group, text in zip(owner, batch["text"].cast(pa.large_string()).cast(pa.large_binary()), strict=True):
            found = TERM.findall(text.as_py().lower())
            terms += found
            sizes.append(len(found))
            own.append(group)
            if len(terms) >= TERMS:
                held.append(_counters(terms, np.repeat(np.arange(len(sizes)), sizes), np.array(own, _I)))
                terms, sizes, own = [], [], []
        if terms:
            held.append(_counters(terms, np.repeat(np.arange(len(sizes)), sizes), np.array(own, _I)))
        if sum(t.num_rows for t in held) >= COUNTERS:
            yield from sent()
    yield from sent()


def _merged(batches, least: int) -> Iterator[pa.Table]:
    """The leaves of a range in order, equal ones as one, without those of fewer documents than ``least``."""
    carry = _LEAF.empty_table()

    def joined(table: pa.Table, starts: np.ndarray, keep: np.ndarray) -> pa.Table:
        """Leaves of the runs of equal rows that begin at ``starts``; only those of ``keep``."""
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        some = table.take(pa.array(np.flatnonzero(keep[run])))
        sources, counts = some["sources"].combine_chunks(), some["counts"].combine_chunks()
        parent = pc.list_parent_indices(sources)
        documents = np.asarray(some["documents"]).astype(_I)
        first = np.asarray(pc.list_value_length(sources)).cumsum() - np.asarray(pc.list_value_length(sources))
        share = np.zeros(len(parent), _I)
        share[first] = documents  # a leaf's documents count once, with its first counter
        return _leaves(pa.table({"lang": some["lang"].combine_chunks().take(parent), "term": some["term"].combine_chunks().take(parent), "source": sources.flatten(), "count": counts.flatten(), "documents": share}))

    for batch in batches:
        table = pa.concat_tables([carry, pa.Table.from_batches([batch]).cast(_LEAF)]).combine_chunks()
        if not table.num_rows:
            continue
        starts = _changes(table["lang"].combine_chunks(), table["term"].combine_chunks())
        documents = np.add.reduceat(np.asarray(table["documents"]), starts)
        keep = documents >= least
        keep[-1] = False
        if keep.any():
            yield joined(table, starts, keep)
        last = table.slice(int(starts[-1]))  # may go on in the next batch
        carry = joined(last, np.zeros(1, _I), np.ones(1, bool)) if last.num_rows > 1 else last
    if carry.num_rows and carry["documents"][0].as_py() >= least:
        yield carry


def front_coded(terms: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Each term as the length of the prefix shared with the one before and its bytes after it: the edges of the trie."""
    shared, rest, before = [], [], b""
    for term in terms:
        n = next((i for i, (a, b) in enumerate(zip(before, term, strict=False)) if a != b), min(len(before), len(term)))
        shared.append(n)
        rest.append(term[n:])
        before = term
    return shared, rest


def traversed(shared: list[int], rest: list[bytes]) -> Iterator[str]:
    """The terms of a front-coded trie in UTF-8 order."""
    path = b""
    for n, suffix in zip(shared, rest, strict=True):
        path = path[:n] + suffix
        yield path.decode()


_BLOCK = pa.schema([("lang", pa.string()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _keep(least: int, block: int):
    """Blocks of the kept terms of a range of prefixes."""

    def packed(lang: str, rows: list[tuple]) -> pa.RecordBatch:
        shared, rest = front_coded([t.encode() for t, _, _ in rows])
        columns = [[lang], [shared], [rest], [[len(s) for _, s, _ in rows]], [[x for _, s, _ in rows for x in s]], [[x for _, _, c in rows for x in c]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)

    def run(batches):
        now, rows = None, []
        for table in _merged(batches, least):
            for lang, term, sources, counts in zip(*(table[c].to_pylist() for c in ("lang", "term", "sources", "counts")), strict=True):
                if rows and (lang != now or len(rows) == block):
                    yield packed(now, rows)
                    rows = []
                now = lang
                rows.append((term, sources, counts))
        if rows:
            yield packed(now, rows)

    return run


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) in whole numbers, by long division in steps of 1000."""
    below = np.asarray(total, _I) + 2 * kept
    if (below > 9 * 10**15).any():
        raise OverflowError("more than 9 x 10^15 terms in a group")
    out, rest = np.zeros(np.broadcast_shapes(np.shape(count), np.shape(below)), _I), np.asarray(count, _I) + 2
    out, rest = out + rest // below, rest % below
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // below, rest * 1000 % below
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("pair", pa.bool_()), ("value", pa.int64())])


def _audit(top: int, cells: int = 1 << 20):
    """Of each block its sums for pairs of sources (each pair once) and the best terms of every source."""

    def rows(lang, source, items, pair, values):
        n = len(items)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(items, pa.string()), pa.array([pair] * n), pa.array(values, pa.int64())], schema=_SUMS)

    def run(batches):
        for batch in batches:
            for lang, shared, rest, sizes, sources, counts, names, totals, kept in zip(*(batch[c].to_pylist() for c in (*_BLOCK.names, "names", "totals", "kept")), strict=True):
                terms = list(traversed(shared, rest))
                place, total = {s: i for i, s in enumerate(names)}, np.array(totals, _I)
                row, column = np.repeat(np.arange(len(terms)), sizes), np.array([place[s] for s in sources])
                step = max(1, cells // len(names))
                sums = {}
                best: list[list] = [[] for _ in names]
                for s in range(0, len(terms), step):
                    some = (row >= s) & (row < s + step)
                    count = np.zeros((min(step, len(terms) - s), len(names)), _I)
                    count[row[some] - s, column[some]] = np.array(counts, _I)[some]
                    p = share(count, total, kept)
                    q = share(count.sum(axis=1), total.sum(), kept)
                    for g in range(len(names)):
                        if g + 1 < len(names):
                            part = divergence(p[:, g, None], p[:, g + 1 :]).sum(axis=0)
                            sums[g] = sums[g] + part if g in sums else part
                        over = np.flatnonzero((count[:, g] > 0) & (p[:, g] > q))
                        f = divergence(p[over, g], q[over])
                        first = np.lexsort((over, -f))[:top]  # terms stand in UTF-8 order
                        best[g] = sorted(best[g] + [(-int(f[i]), s + int(over[i])) for i in first])[:top]
                for g, name in enumerate(names):
                    if g in sums:
                        yield rows(lang, name, names[g + 1 :], True, sums[g])
                    if best[g]:
                        yield rows(lang, name, [terms[i] for _, i in best[g]], False, [-f for f, _ in best[g]])

    return run


def audit(docs: DataFrame, *, least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = durable(texts.select("lang", "source").distinct(), "groups")
    leaves = durable(texts.mapInArrow(_count, "lang string, term string, documents long, sources array<string>, counts array<long>"), "leaves")  # ranges are sampled from it
    ranged = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    blocks = durable(ranged.mapInArrow(_keep(least, BLOCK), "lang string, shared array<int>, rest array<binary>, sizes array<int>, sources array<string>, counts array<long>"), "tries")
    release(leaves)
    kept = blocks.groupBy("lang").agg(F.sum(F.size("shared")).alias("kept"))
    totals = blocks.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    known = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")).alias("x"))
    known = known.groupBy("lang").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a language's sources: what its pairs are the square of
    known = known.select("lang", F.col("x.source").alias("names"), F.col("x.total").alias("totals")).join(kept, "lang")
    found = durable(blocks.join(known, "lang").mapInArrow(_audit(top), "lang string, source string, item string, pair boolean, value long"), "audit")
    half = found.filter("pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(other, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    terms = found.filter("not pair").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
