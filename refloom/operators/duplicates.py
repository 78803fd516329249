"""Duplicate references, denylisted venues and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.text import bind, filled, plain_key
from refloom.operators.stored import stored


#: Characters at the start of a short key that the longer one must hold.
GRAM = 20


def _keyed(refs: DataFrame) -> DataFrame:
    return refs.select("batch_id", "seq", plain_key(F.coalesce(filled(F.col("title")), F.col("raw"))).alias("key"))


def _links(keyed: DataFrame) -> DataFrame:
    """(batch_id, inner, outer): different keys of over 20 characters of a batch, one inside the other.

    The interior words of the inner key stand whole in the outer one, so both meet on the
    inner key's longest interior word; keys of under three words meet the outer key on
    their first ``GRAM`` characters.  Repeated keys are compared once.
    """
    long = keyed.filter(F.length("key") > 20).select("batch_id", "key").distinct().withColumn("words", F.split("key", " "))
    middle = F.array_max(F.transform(F.slice("words", F.lit(2), F.size("words") - 2), lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    at = ["batch_id", "part"]
    anchored = long.filter(F.size("words") >= 3).select("batch_id", middle.alias("part"), F.col("key").alias("inner"))
    words = long.select("batch_id", F.explode(F.array_distinct("words")).alias("part"), F.col("key").alias("outer"))
    short = long.filter(F.size("words") < 3).select("batch_id", F.substring("key", 1, GRAM).alias("part"), F.col("key").alias("inner"))
    grams = F.transform(F.sequence(F.lit(1), F.length("key") - GRAM + 1), lambda i: F.substring("key", i, F.lit(GRAM)))
    spread = long.join(short.select("batch_id").distinct(), "batch_id", "left_semi").select("batch_id", F.explode(F.array_distinct(grams)).alias("part"), F.col("key").alias("outer"))
    inside = (F.col("inner") != F.col("outer")) & F.col("outer").contains(F.col("inner"))
    return anchored.join(words, at).filter(inside).drop("part").unionByName(short.join(spread, at).filter(inside).drop("part")).distinct()


def duplicate_pairs(refs: DataFrame) -> DataFrame:
    """(batch_id, orig_seq, dup_seq): equal keys (empty ones too), or one of over 20 characters in the other.

    As many rows as there are pairs; ``duplicate_classes`` and ``last_originals`` give the duplicates without them.
    """
    keyed = _keyed(refs)
    x, y = keyed.alias("x"), keyed.alias("y")
    pair = [F.col("x.batch_id").alias("batch_id"), F.least("x.seq", "y.seq").alias("orig_seq"), F.greatest("x.seq", "y.seq").alias("dup_seq")]
    equal = x.join(y, (F.col("x.batch_id") == F.col("y.batch_id")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.seq") < F.col("y.seq"))).select(*pair)
    links = _links(keyed)
    held = links.join(keyed.withColumnRenamed("key", "inner").withColumnRenamed("seq", "a"), ["batch_id", "inner"]).join(keyed.withColumnRenamed("key", "outer").withColumnRenamed("seq", "b"), ["batch_id", "outer"])
    return equal.unionByName(held.filter("a <> b").select("batch_id", F.least("a", "b").alias("orig_seq"), F.greatest("a", "b").alias("dup_seq"))).distinct()


def duplicate_classes(refs: DataFrame) -> DataFrame:
    """(batch_id, seq, class_id, n_links, linked): the links of ``duplicate_pairs`` without the pairs.

    References of equal keys are one class, named after its first one; ``n_links`` counts
    the references that each is linked to, ``linked`` lists the classes of other keys among them.
    """
    keyed = _keyed(refs)
    classes = keyed.groupBy("batch_id", "key").agg(F.min("seq").alias("class_id"), F.count("*").alias("n"))
    links = _links(keyed)
    both = links.select("batch_id", F.col("inner").alias("own"), F.col("outer").alias("key")).unionByName(links.select("batch_id", F.col("outer").alias("own"), F.col("inner").alias("key")))
    others = both.join(classes, ["batch_id", "key"]).groupBy("batch_id", F.col("own").alias("key")).agg(F.sum("n").alias("others"), F.array_sort(F.collect_list("class_id")).alias("linked"))
    whole = classes.join(others, ["batch_id", "key"], "left")
    n_links = F.col("n") - 1 + F.coalesce("others", F.lit(0))
    return keyed.join(whole, ["batch_id", "key"]).select("batch_id", "seq", "class_id", n_links.cast("long").alias("n_links"), F.coalesce("linked", F.array().cast(whole.schema["linked"].dataType)).alias("linked"))


def last_originals(refs: DataFrame) -> DataFrame:
    """(batch_id, seq, duplicate_of): the label of the last earlier reference that each repeats.

    Among equal keys that is the one before; among linked keys the rows of both are read
    in order of their place, so the work grows with the rows and not with their pairs.
    """
    keyed = stored(_keyed(refs), "keyed")  # many steps read the keys
    equal = keyed.withColumn("orig_seq", F.lag("seq").over(Window.partitionBy("batch_id", "key").orderBy("seq"))).filter("orig_seq is not null").select("batch_id", "seq", "orig_seq")
    links = _links(keyed)
    both = links.select("batch_id", F.struct("inner", "outer").alias("link"), F.explode(F.array(F.struct(F.lit(True).alias("within"), F.col("inner").alias("key")), F.struct(F.lit(False).alias("within"), F.col("outer").alias("key")))).alias("x"))
    rows = both.select("batch_id", "link", "x.within", "x.key").join(keyed, ["batch_id", "key"])
    before = Window.partitionBy("batch_id", "link").orderBy("seq", "within").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda within: F.max(F.when(F.col("within") == within, F.col("seq"))).over(before)
    crossed = rows.withColumn("orig_seq", F.when(F.col("within"), last(False)).otherwise(last(True))).filter("orig_seq < seq").select("batch_id", "seq", "orig_seq")
    found = equal.unionByName(crossed).groupBy("batch_id", "seq").agg(F.max("orig_seq").alias("orig_seq"))
    return found.join(_labels(refs), ["batch_id", "orig_seq"]).select("batch_id", "seq", "duplicate_of")


def _labels(refs: DataFrame) -> DataFrame:
    return refs.select("batch_id", F.col("seq").alias("orig_seq"), F.coalesce(F.nullif("ref_number", F.lit(0)), F.col("seq") + 1).alias("duplicate_of"))


#: Names that are matched as literals, names in an automaton, venues that one task looks through.
LITERAL_NAMES = 200
SHARD_NAMES = 50_000
PART_VENUES = 100_000


def _holding(names, venues):
    """The venues that hold one of the names: one pass of an automaton (a trie with failure links) over each."""
    import ahocorasick
    import pyarrow as pa

    found: list[str] = []
    if names.num_rows and venues.num_rows:
        automaton = ahocorasick.Automaton()
        for name in names["k"].to_pylist():
            automaton.add_word(name, True)
        automaton.make_automaton()
        found = [v for v in venues["v"].to_pylist() if next(automaton.iter(v), None)]
    return pa.table({"v": pa.array(found, pa.string())})


def venues_holding(venues: DataFrame, listed: DataFrame) -> DataFrame:
    """The (distinct, non-null) venues ``v`` that contain one of the names ``k``.

    Names are dealt to shards, each of which is one automaton whose memory is linear in
    its names; every venue visits every shard, in parts of bounded size.
    """
    shards, parts = (max(1, -(-df.count() // most)) for df, most in ((listed, SHARD_NAMES), (venues, PART_VENUES)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    names = listed.select("k", F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard"), every(parts).alias("part"))
    rows = venues.select("v", every(shards).alias("shard"), F.pmod(F.xxhash64("v"), F.lit(parts)).alias("part"))
    return names.groupBy("shard", "part").cogroup(rows.groupBy("shard", "part")).applyInArrow(_holding, "v string")


def on_denylist(results: DataFrame, names: DataFrame, venue_col: str = "venue") -> DataFrame:
    """``results`` with ``predatory``: the venue contains a listed name.

    A short list is read once as literals; a longer one, of any length, becomes
    automata through which the distinct venues pass.
    """
    key = plain_key(F.coalesce(F.col(venue_col), F.lit("")))
    listed = names.select(plain_key(F.col("name")).alias("k")).filter("k <> ''").distinct()
    short = [r[0] for r in listed.limit(LITERAL_NAMES + 1).collect()]
    if len(short) <= LITERAL_NAMES:
        held = lambda v: F.exists(F.array(*[F.lit(x) for x in sorted(short)]), lambda n: v.contains(n))
        return results.withColumn("predatory", bind(key, held) if short else F.lit(False))
    hit = venues_holding(results.select(key.alias("v")).distinct(), listed).distinct()
    joined = results.withColumn("_venue", key).join(hit.select(F.col("v").alias("_venue"), F.lit(True).alias("_hit")), "_venue", "left")
    return joined.withColumn("predatory", F.coalesce("_hit", F.lit(False))).drop("_venue", "_hit")


def exactly_listed(results: DataFrame, names: DataFrame, venue_col: str = "venue") -> DataFrame:
    """``results`` with ``listed``: the venue is a listed name, letter for letter but for case."""
    listed = names.select(F.lower("name").alias("_name"), F.lit(True).alias("_listed")).distinct()
    joined = results.withColumn("_name", F.lower(F.col(venue_col))).join(listed, "_name", "left")
    return joined.withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_name", "_listed")


def not_processed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items whose key is not among the processed ones."""
    return items.join(done.select(key).distinct(), key, "left_anti")
