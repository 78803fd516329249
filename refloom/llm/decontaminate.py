"""Benchmark decontamination: a broadcast set of normalised test n-grams.

The windows of the test items (10 words; a shorter item is one window) form a
hash set.  Every token window of the training documents is hashed and looked up
there, each hit is verified word by word, and the words of all verified windows
are the hit spans.  Up to ``set_windows`` windows are a predicate of the scan, which
only hashes windows around their longest words.  Beyond, the hashes of all token
windows stream past the set as a join: broadcast while the set has at most
``BROADCAST_WINDOWS`` hashes (8 bytes each), shuffled by hash after that.  Only
places of hits leave that join; their words are taken from the texts again.

Defined cases: null or wordless texts and items have no windows; texts and items of
any length are scanned whole; repeated documents each get their row, equal texts
the same spans; a null item id marks words but is no item; items with equal windows
each count; empty tables give no hits; other columns are ignored or kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.durable import durable
from refloom.llm.text import plain_words

#: Words in a window.
WINDOW = 10
#: Beyond so many windows the hashes of all token windows are joined instead.
SET_WINDOWS = 50_000
#: A joined set is broadcast up to so many hashes.
BROADCAST_WINDOWS = 4_000_000

_FOUND = "array<struct<pos:int,len:int,gram_hash:bigint,words:array<string>>>"


def item_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items: item, len, gram (words), gram_hash."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return (
        words.select("item", length.alias("len"), F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("gram"))
        .distinct()
        .withColumn("gram_hash", F.xxhash64("gram"))
    )


def _small(grams: DataFrame, set_windows: int) -> bool:
    return grams.limit(set_windows + 1).count() <= set_windows


def candidates(docs: DataFrame, grams: DataFrame, *, keep: list, text_col: str = "text") -> DataFrame:
    """``keep`` columns, content, n_words, and the windows whose hash is in a small set.

    ``found`` is an array of (pos from 0, len, gram_hash, words).
    """
    known: dict[int, list[int]] = {}
    anchors: dict[int, set[str]] = {}
    longest = F.array_max(F.transform("gram", lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"]
    for r in grams.select("len", "gram_hash", longest.alias("anchor")).distinct().collect():
        known.setdefault(r["len"], []).append(r["gram_hash"])
        anchors.setdefault(r["len"], set()).add(r["anchor"])
    tokens = docs.select(*keep, content_key(text_col), plain_words(F.col(text_col)).alias("w"))
    found = F.array().cast(_FOUND)
    for length in sorted(known):
        last = F.size("w") - length  # the last start
        # a window holds its longest word: only windows around such words are hashed
        places = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(sorted(anchors[length])), i)))  # noqa: B023
        around = lambda p: F.sequence(F.greatest(p - length + 1, F.lit(0)), F.least(p, last))  # noqa: B023, E731
        starts = F.array_distinct(F.flatten(F.transform(places, around)))
        at = lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice("w", i + 1, F.lit(length))).alias("gram_hash"))  # noqa: B023, E731
        some = F.filter(F.transform(starts, at), lambda x: x["gram_hash"].isin(known[length]))  # noqa: B023
        whole = F.transform(some, lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), x["gram_hash"].alias("gram_hash"), F.slice("w", x["pos"] + 1, x["len"]).alias("words")))
        found = F.concat(found, F.when(last >= 0, whole).otherwise(F.array().cast(_FOUND)))
    return tokens.select(*keep, "content", F.size("w").cast("long").alias("n_words"), found.alias("found"))


def streamed(docs: DataFrame, grams: DataFrame, text_col: str = "text") -> DataFrame:
    """content and ``found`` of the texts with windows in a large set, one row per text."""
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most n
    words = docs.select(content_key(text_col), plain_words(F.col(text_col)).alias("w"))
    starts = lambda n: F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
    hashed = [F.transform(starts(n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.slice("w", i + 1, F.lit(n))).alias("gram_hash"))) for n in lengths]  # noqa: B023
    windows = words.select("content", F.inline(F.concat(*hashed) if hashed else F.array().cast("array<struct<pos:int,len:int,gram_hash:bigint>>")))
    known = grams.select("gram_hash", "len").distinct()
    known = F.broadcast(known) if _small(known, BROADCAST_WINDOWS) else known
    hits = windows.join(known, ["gram_hash", "len"]).groupBy("content").agg(F.collect_set(F.struct("pos", "len", "gram_hash")).alias("hits"))
    hits = durable(hits, "hits")
    whole = F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), x["gram_hash"].alias("gram_hash"), F.slice("w", x["pos"] + 1, x["len"]).alias("words")))
    return words.join(hits, "content").groupBy("content").agg(F.any_value(whole).alias("found"))


def verified(found: DataFrame, grams: DataFrame) -> DataFrame:
    """Verified window occurrences: content, pos, len, item."""
    spots = found.filter(F.size("found") > 0).select("content", F.inline("found"))
    return spots.join(grams.select("gram_hash", "gram", "item"), "gram_hash").filter(F.col("words") == F.col("gram")).select("content", "pos", "len", "item")


def content_key(text_col: str = "text"):
    """Key of a text: rows with one text have the same hits."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("content")


def judge(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, *, id_col: str = "doc_id", text_col: str = "text", set_windows: int = SET_WINDOWS) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted array), spans, contaminated.

    ``spans`` are the merged hit ranges as (first, last) word numbers.
    """
    grams = durable(item_windows(benchmark, n), "grams")
    if _small(grams, set_windows):
        rows = durable(candidates(docs, grams, keep=[id_col], text_col=text_col), "windows")
        found = rows
    else:
        rows = docs.select(id_col, content_key(text_col), F.size(plain_words(F.col(text_col))).cast("long").alias("n_words"))
        found = durable(streamed(docs, grams, text_col), "windows")
    spot = F.struct(F.col("pos").alias("first"), (F.col("pos") + F.col("len") - 1).alias("last"))
    merge = F.aggregate(
        F.array_sort("spots"),
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["last"] >= s["first"] - 1),
            F.concat(
                F.slice(a, F.lit(1), F.size(a) - 1),
                F.array(F.struct(F.try_element_at(a, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(a, F.lit(-1))["last"], s["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(a, F.array(s))),
    )
    per_text = (
        verified(found, grams)
        .groupBy("content")
        .agg(F.collect_set(spot).alias("spots"), F.array_sort(F.collect_set("item")).alias("items"))
        .select("content", "items", merge.alias("spans"))
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return rows.select(id_col, "content", "n_words").join(per_text, "content", "left").select(
        id_col,
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
        F.col("spans").isNotNull().alias("contaminated"),
        "content",
    )


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, set_windows: int) -> DataFrame:
    grams = durable(item_windows(benchmark, n), "grams")
    found = candidates(docs, grams, keep=[], text_col=text_col) if _small(grams, set_windows) else streamed(docs, grams, text_col)
    return verified(durable(found, "windows"), grams)  # a filter pushed below it would split the texts anew for each word


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """``row`` (all columns) and content."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), content_key(text_col))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, *, text_col: str = "text", set_windows: int = SET_WINDOWS) -> DataFrame:
    """The documents without any hit, with all their columns."""
    hit = durable(_hits(docs, benchmark, n, text_col, set_windows).select("content").distinct(), "hits")
    return _rows(docs, text_col).join(hit, "content", "left_anti").select("row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, *, text_col: str = "text", set_windows: int = SET_WINDOWS) -> DataFrame:
    """All documents with the words of hit spans (and the separators before them) taken out."""
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = F.col("row")[text_col]
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    spot = F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)
    hit = _hits(docs, benchmark, n, text_col, set_windows).groupBy("content").agg(F.array_distinct(F.flatten(F.collect_list(spot))).alias("hit"))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    kept = F.filter(pieces, lambda x: ~F.array_contains("hit", x["i"]))
    cut = F.when(F.col("hit").isNull(), text).otherwise(F.concat(F.array_join(F.transform(kept, lambda x: x["w"]), ""), tail))
    joined = _rows(docs, text_col).join(hit, "content", "left")
    return joined.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
