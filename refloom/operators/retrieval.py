"""Ranked retrieval: the k records of each source that share the weightiest words with a query.

A word's weight in a source is its inverse document frequency, ``ln(1 + records /
records with the word)`` in whole millionths, so that sums are exact and independent of
their order; a record's score is the sum over the words it shares with the query, ties
go to the smaller id.

Rare words read their postings.  Frequent words do not meet record by record: what counts
of a record that shares no rare word with a query is its set of frequent words.  Records
of one set are one class, of which only the k smallest ids can be results, and queries of
the same frequent words ask once.  Classes are searched rarest word first, in rounds: a
class that shares none of the words read so far scores at most the sum of the weights of
the others, so once the kth score is above that sum, the remaining words read no postings.
A query whose kth record by rare words is above all that its frequent words can give does
not ask at all.  What is kept is what reading all postings would give: a record that k
others beat by their frequent words alone is beaten by them in full as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.text import fold
from refloom.operators.stored import Scratch, stored

#: Records that hold a rare word, at most; then the postings of classes that a query reads up to each round, what is beyond the last in one more.
ROUNDS = (256, 16_384)


def title_words(col: Column) -> Column:
    """Distinct folded words of three characters or more."""
    return F.array_distinct(F.filter(F.split(fold(col), r"\s+"), lambda w: F.length(w) >= 3))


def weight(records: Column, holders: Column) -> Column:
    return F.floor(F.log(1 + records / holders) * 1_000_000 + 0.5).cast("long")


def _key(words: Column) -> Column:
    """A key of a sorted array of words."""
    return F.unhex(F.md5(F.array_join(words, " ")))


def indexed(catalog: DataFrame, text_col: str = "title") -> DataFrame:
    """(source, source_rank, rec_id, words): what is searched."""
    return stored(catalog.select("source", "source_rank", "rec_id", title_words(F.col(text_col)).alias("words")), "records")


def query_terms(asked: DataFrame, records: DataFrame) -> DataFrame:
    """(query, source, word, holders, weight) of (query, words) in each source."""
    size = records.groupBy("source").agg(F.count("*").alias("n"))
    held = records.select("source", F.explode("words").alias("word")).groupBy("source", "word").agg(F.count("*").alias("holders"))
    words = held.join(F.broadcast(size), "source").select("source", "word", "holders", weight(F.col("n"), F.col("holders")).alias("weight"))  # one row a source
    return asked.select("query", F.explode("words").alias("word")).join(words, "word").select("query", "source", "word", "holders", "weight")


def ordered(terms: DataFrame) -> DataFrame:
    """``terms`` with ``rest``, the most that can be scored whose rarest shared word is this one, and ``reach``, the postings of this and all rarer words of the query."""
    common_first = Window.partitionBy("query", "source").orderBy(F.desc("holders"), F.desc("word"))
    rare_first = Window.partitionBy("query", "source").orderBy("holders", "word").rowsBetween(Window.unboundedPreceding, 0)
    summed = terms.withColumn("rest", F.sum("weight").over(common_first.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.withColumn("reach", F.sum("holders").over(rare_first))


def in_round(terms: DataFrame, n: int, rounds: tuple[int, ...]) -> DataFrame:
    """The terms whose postings are read in round n, bounds aside; the rarest word is always read in the first."""
    above = F.lit(True) if n == 0 else (F.col("reach") > rounds[n - 1]) & (F.col("reach") > F.col("holders"))
    below = F.lit(True) if n == len(rounds) else (F.col("reach") <= rounds[n]) | (F.lit(n == 0) & (F.col("reach") == F.col("holders")))
    return terms.filter(above & below)


def _wanted(terms: DataFrame) -> DataFrame:
    return terms.groupBy("query", "source").agg(F.collect_list(F.struct("word", "weight")).alias("wanted"))


def _scored(reading: DataFrame, wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(query, source, source_rank, rec_id, hits, score) of the records in the postings of ``reading``."""
    postings = records.select("source", "rec_id", F.explode("words").alias("word"))
    met = reading.select("query", "source", "word").join(postings, ["source", "word"]).select("query", "source", "rec_id").distinct()
    both = met.join(records, ["source", "rec_id"]).join(wanted, ["query", "source"])
    both = both.select("query", "source", "source_rank", "rec_id", "wanted", F.array_intersect(F.transform("wanted", lambda t: t["word"]), "words").alias("shared"))
    total = F.aggregate("wanted", F.lit(0).cast("long"), lambda s, t: s + F.when(F.array_contains("shared", t["word"]), t["weight"]).otherwise(0))
    return both.select("query", "source", "source_rank", "rec_id", F.size("shared").cast("long").alias("hits"), total.alias("score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query and source; a record that is there twice counts by its higher score."""
    once = found.groupBy("query", "source", "rec_id").agg(F.max(F.struct("score", "hits", "source_rank")).alias("x")).select("query", "source", "x.source_rank", "rec_id", "x.hits", "x.score")
    order = Window.partitionBy("query", "source").orderBy(F.desc("score"), "rec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _classes(words: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(source, rec_id, words, members): the sets of the frequent ``words`` that records hold, under a key in the place of an id, and their k first records."""
    # the key of all words is made once a record: beside an explode it would be made for every word
    keyed = records.select("source", "source_rank", "rec_id", _key(F.col("words")).alias("whole"), "words")
    spread = keyed.select("source", "source_rank", "rec_id", "whole", F.explode("words").alias("word")).join(words, ["source", "word"], "left_semi")
    sets = spread.groupBy("source", "source_rank", "rec_id", "whole").agg(F.array_sort(F.collect_set("word")).alias("words"))
    rows = sets.select("source", "source_rank", "rec_id", _key(F.col("words")).alias("class"), "words").distinct()
    first = Window.partitionBy("source", "class").orderBy("rec_id", "source_rank")
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    return rows.groupBy("source", "class").agg(F.first("words").alias("words"), F.collect_list(F.struct("rec_id", "source_rank")).alias("members")).withColumnRenamed("class", "rec_id")


def _frequent(asked: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """The k best records of each (query, words) by its frequent words alone, ``words`` being (word, weight) in one source."""
    terms = asked.select("query", "source", F.explode("words").alias("t")).select("query", "source", "t.word", "t.weight")
    classes = stored(_classes(terms.select("source", "word").distinct(), records, k), "classes")
    held = classes.select("source", F.explode("words").alias("word")).groupBy("source", "word").agg(F.count("*").alias("holders"))
    terms = stored(ordered(terms.join(held, ["source", "word"])), "class-terms")
    wanted, members = _wanted(terms), classes.select("source", "rec_id", F.explode("members").alias("m"))
    plain = classes.select("source", F.lit(0).alias("source_rank"), "rec_id", "words")
    found = None
    for n in range(len(ROUNDS)):
        reading = in_round(terms, n, ROUNDS[1:])
        if found is not None:
            kth = found.filter(F.col("rank") == k).select("query", "source", F.col("score").alias("kth"))
            reading = stored(reading.join(kth, ["query", "source"], "left").filter(F.col("kth").isNull() | (F.col("rest") >= F.col("kth"))), "open-terms")
            if reading.isEmpty():
                continue
        # no cut of classes before their records are known: of classes of equal score, any can hold the smaller ids
        more = _scored(reading, wanted, plain).join(members, ["source", "rec_id"]).select("query", "source", "m.source_rank", "m.rec_id", "hits", "score")
        found = stored(_best(more if found is None else found.drop("rank").unionByName(more), k), "found-classes")
    return found


def search(asked: DataFrame, records: DataFrame, k: int = 5) -> DataFrame:
    """(query, source, source_rank, rec_id, hits, score, rank): the k best of each source for each (query, words)."""
    terms = stored(query_terms(asked, records), "terms")
    rare = F.col("holders") <= ROUNDS[0] if ROUNDS else F.lit(True)
    found = stored(_best(_scored(terms.filter(rare), _wanted(terms), records), k), "found")
    kth = found.filter(F.col("rank") == k).select("query", "source", F.col("score").alias("kth"))
    frequent = terms.filter(~rare).groupBy("query", "source").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("words"), F.sum("weight").alias("most"))
    open_ = frequent.join(kth, ["query", "source"], "left").filter(F.col("kth").isNull() | (F.col("most") >= F.col("kth")))
    open_ = stored(open_.select("query", "source", _key(F.col("words")["word"]).alias("class"), "words"), "open")
    if open_.isEmpty():
        return found
    by_class = _frequent(open_.select(F.col("class").alias("query"), "source", "words").dropDuplicates(["query", "source"]), records, k)
    more = open_.select("query", "source", "class").join(by_class.withColumnRenamed("query", "class").drop("rank"), ["class", "source"]).drop("class")
    return stored(_best(found.drop("rank").unionByName(more), k), "found")


def candidates(refs: DataFrame, catalog: DataFrame, k: int = 5, query_col: str = "title") -> DataFrame:
    """(ref_id, source, source_rank, rec_id, hits, weight, rank): the k records of each source with the weightiest shared words."""
    words = F.array_sort(title_words(F.col(query_col)))
    keyed = refs.select("ref_id", words.alias("words")).filter(F.size("words") > 0).withColumn("query", _key(F.col("words")))
    with Scratch() as scratch:
        keyed = stored(keyed, "queries")
        found = search(keyed.select("query", "words").distinct(), indexed(catalog), k)
        named = keyed.select("ref_id", "query").join(found, "query").select("ref_id", "source", "source_rank", "rec_id", "hits", F.col("score").alias("weight"), "rank")
        return scratch.keep(stored(named, "candidates"))
