"""Spelling variant grouping: words that differ by one inserted, deleted or replaced code point.

If two words differ by one edit, one of the two halves of either stands unchanged at
the start or at the end of the other.

1. words are counted by task and then by word; some runs are damaged on purpose, as
   the contract of the operator says;
2. both halves of every word are dealt to shards by a hash; a word is sent to the
   shards of the (at most four) starts and ends of itself that can be such a half;
3. each shard builds one Aho-Corasick automaton over its halves and runs it over its
   words; a hit must stand at the word's start (or end), the lengths must differ by one
   at most, and the distance is verified on the other half;
4. halves that more than ``HOT`` words share stay out of the automata: their words are
   joined by what is left of the other half when one code point goes, so that no group
   holds more than one word for each place and letter;
5. every word takes its most frequent near word as its form if that has at least
   ``RATIO`` times its occurrences, and follows forms to its root by pointer doubling.

Defined cases: null text has no words; a null id is written as nothing in the key of the
damage; repeated rows count again; words and texts of any length are read whole; ties
go to the word first in code-point order; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.durable import durable

#: Fixed values of the contract: runs of A-Z, a-z and U+00C0-U+00FF (as UTF-8), what is damaged, and which words count.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
DAMAGE = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
#: Distinct words that a task holds before it sends them, halves in a shard, words that share a half in an automaton.
HELD = 200_000
SHARD = 4_000
HOT = 64


def damaged(doc_id, run: str) -> str:
    """The lower-cased run, without one code point where the checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches):
    """Words of the texts (doc_id, text) with their occurrences."""
    words: Counter = Counter()

    def sent():
        kept = [(w, n) for w, n in words.items() if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    for batch in batches:
        texts = batch["text"].cast(pa.large_string()).cast(pa.large_binary())
        for doc_id, text in zip(batch["doc_id"].to_pylist(), texts, strict=True):
            for run, n in Counter(x.lower() for x in RUN.findall(text.as_py() or b"")).items():
                words[damaged(doc_id, run.decode())] += n
            if len(words) > HELD:
                yield sent()
                words.clear()
    yield sent()


def one_edit(a: str, b: str) -> bool:
    """a and b, which are not equal, differ by one edit."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


_NEAR = "word string, near string, near_n long"


def _shard(key, table):
    """Near words of a shard: its halves' automaton over its words."""
    rows = list(zip(*(table[c].to_pylist() for c in ("side", "half", "word", "n")), strict=True))
    holders: dict = defaultdict(lambda: ([], []))
    for side, half, word, n in rows:
        if half is not None:
            holders[half][side].append((word, n))
    out = []
    if holders:
        automaton = ahocorasick.Automaton()
        for half, sides in holders.items():
            automaton.add_word(half, (len(half), sides))
        automaton.make_automaton()
        for word in {w for _, half, w, _ in rows if half is None}:
            for end, (length, sides) in automaton.iter(word):
                if end + 1 == length:  # a left half at the start
                    out += [(word, y, n) for y, n in sides[0] if abs(len(y) - len(word)) < 2 and y != word and one_edit(word[length:], y[length:])]
                if end + 1 == len(word):  # a right half at the end; with its left half at the start it is found there
                    out += [(word, y, n) for y, n in sides[1] if abs(len(y) - len(word)) < 2 and y != word and not word.startswith(y[:-length]) and one_edit(word[:-length], y[:-length])]
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["word", "near", "near_n"])


def _halves(words: DataFrame) -> DataFrame:
    """(word, n, side, half): the left (0) and right (1) half of every word."""
    size = F.length("word")
    left = F.floor(size / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), left).alias("half")), F.struct(F.lit(1).alias("side"), F.substring("word", left + 1, size - left).alias("half")))
    return words.select("word", "n", F.explode(both).alias("x")).select("word", "n", "x.side", "x.half")


def _ends(words: DataFrame) -> DataFrame:
    """(word, n, side, half): the starts and ends of a word that are half of a word whose length differs by one at most."""
    size = F.length("word")
    near = F.filter(F.array(size - 1, size, size + 1), lambda m: m >= LEAST_LENGTH)
    left = F.array_distinct(F.transform(near, lambda m: F.floor(m / 2).cast("int")))
    right = F.array_distinct(F.transform(near, lambda m: (m - F.floor(m / 2)).cast("int")))
    starts = F.transform(left, lambda m: F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), m).alias("half")))
    ends = F.transform(right, lambda m: F.struct(F.lit(1).alias("side"), F.substring("word", size - m + 1, m).alias("half")))
    return words.select("word", "n", F.explode(F.concat(starts, ends)).alias("x")).select("word", "n", "x.side", "x.half")


def _rest(word: Column, side: Column, half: Column) -> Column:
    """What a word holds beside one of its ends."""
    size, cut = F.length(word), F.length(half)
    return F.when(side == 0, F.substring(word, cut + 1, size - cut)).otherwise(F.substring(word, F.lit(1), size - cut))


def _hot(halves: DataFrame, ends: DataFrame) -> DataFrame:
    """Near words among those that share a hot half: equal rests but for one code point, verified."""
    rest = _rest(F.col("word"), F.col("side"), F.col("half"))
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length("rest"), F.lit(1))), lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.substring("rest", i + 1, F.length("rest"))))
    spread = lambda df: df.withColumn("rest", rest).withColumn("left_over", F.explode(F.array_distinct(F.concat(F.array("rest"), without))))
    y = spread(halves).select("side", "half", "left_over", F.col("word").alias("near"), F.col("n").alias("near_n"))
    x = spread(ends).select("side", "half", "left_over", "word")
    near = x.join(y, ["side", "half", "left_over"]).filter((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    own = F.substring("near", F.lit(1), F.length("near") - F.length("half"))
    return near.filter((F.col("side") == 0) | ~F.col("word").startswith(own)).select("word", "near", "near_n").distinct()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that count."""
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, in both directions."""
    halves, ends = _halves(words), _ends(words)
    crowd = durable(halves.groupBy("side", "half").count().filter(F.col("count") > HOT).select("side", "half"), "hot-halves")
    shards = F.lit(max(1, -(-2 * words.count() // SHARD)))
    shard = F.pmod(F.xxhash64("side", "half"), shards)
    dealt = halves.join(crowd, ["side", "half"], "left_anti").select(shard.alias("shard"), "side", "half", "word", "n")
    sent = ends.join(crowd, ["side", "half"], "left_anti").select(shard.alias("shard"), "word").distinct()
    sent = sent.select("shard", F.lit(None).cast("int").alias("side"), F.lit(None).cast("string").alias("half"), "word", F.lit(None).cast("long").alias("n"))
    cool = dealt.unionByName(sent).groupBy("shard").applyInArrow(_shard, _NEAR)
    return cool.unionByName(_hot(halves.join(crowd, ["side", "half"]), ends.join(crowd, ["side", "half"])))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): counts double at least with each step, so a few doublings reach every root."""
    reached = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that counts."""
    words = durable(count_words(docs), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    often = -F.col("best.less")
    takes = F.col("best").isNotNull() & (often >= RATIO * F.col("n"))
    linked = durable(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, often).alias("form_n")), "forms")
    root = roots(linked.filter("form is not null"))
    return linked.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
