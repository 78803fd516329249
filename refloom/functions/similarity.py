"""Similarity of titles, names and venues, as column expressions from 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from refloom.functions.text import SPACE, adapter_key, bind, fold, rounded, trim, word_characters

_WORDS = f"[{SPACE}]+"


def _tokens(col: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(col, _WORDS), ""))


def edit_similarity(a: Column, b: Column) -> Column:
    """round((1 - levenshtein / longer length) x 100)."""
    longest = F.greatest(F.length(a), F.length(b))
    return rounded((1 - F.levenshtein(a, b) / longest) * 100)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words; accented letters count as none."""
    clean = lambda c: _tokens(word_characters(F.lower(c)))
    return _overlap(clean(a), clean(b))


def _overlap(a: Column, b: Column) -> Column:
    def score(p):
        x, y = p["x"], p["y"]
        return F.when((F.size(x) > 0) & (F.size(y) > 0), rounded(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) * 100)).otherwise(F.lit(0).cast("long"))

    return bind(F.struct(a.alias("x"), b.alias("y")), score)


def _better(x: Column, y: Column, a: Column, b: Column, overlap: Column | None = None) -> Column:
    """The better of edit similarity of the folded x and y and word overlap of a and b."""
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    overlap = word_overlap(a, b) if overlap is None else overlap
    return F.when(empty, F.lit(0).cast("long")).when(x == y, F.lit(100).cast("long")).otherwise(F.greatest(edit_similarity(x, y), overlap))


def similarity(a: Column, b: Column) -> Column:
    """The better of edit similarity of the folded and word overlap of the raw strings."""
    return bind(F.struct(fold(a).alias("x"), fold(b).alias("y")), lambda p: _better(p["x"], p["y"], a, b))


def forms(col: Column) -> Column:
    """What the similarities read of a string, for strings that are compared many times: empty, folded, key and words."""
    key = adapter_key(col)
    return F.struct((F.coalesce(col, F.lit("")) == "").alias("empty"), fold(col).alias("folded"), key.alias("key"), _tokens(key).alias("words"))


def similarity_of_forms(a: Column, b: Column) -> Column:
    """``similarity`` of two strings by their ``forms``."""
    x, y = a["folded"], b["folded"]
    none = F.lit(0).cast("long")
    return F.when(a["empty"] | b["empty"], none).when(x == y, F.lit(100).cast("long")).otherwise(F.greatest(edit_similarity(x, y), _overlap(a["words"], b["words"])))


def adapter_similarity_of_forms(a: Column, b: Column) -> Column:
    """``adapter_similarity`` of two strings by their ``forms``."""
    return _shared_words(a["key"] == b["key"], a["words"], b["words"])


def free_text_similarity_of_forms(query: Column, title: Column) -> Column:
    """``free_text_similarity`` of two strings by their ``forms``."""
    return _free_text(query["folded"], title["folded"], similarity_of_forms(query, title))


def title_similarity(expected: Column, found: Column) -> Column:
    """As ``similarity`` of the folded titles; 95 if the expected one contains the found one."""
    return folded_title_similarity(fold(F.coalesce(expected, F.lit(""))), fold(F.coalesce(found, F.lit(""))))


def folded_title_similarity(expected: Column, found: Column) -> Column:
    """``title_similarity`` of titles that are folded already."""
    folded = F.struct(expected.alias("x"), found.alias("y"))

    def score(p):
        x, y = p["x"], p["y"]  # folding a folded title changes nothing, nor does cleaning its words
        held = x.contains(y) & (F.length(y) > 20)
        return bind(_better(x, y, x, y, _overlap(_tokens(x), _tokens(y))), lambda s: F.when((s < 90) & held, F.lit(95).cast("long")).otherwise(s))

    return bind(folded, score)


def family_name(name: Column) -> Column:
    """The last word of the folded name that is no number."""
    parts = F.filter(F.split(fold(name), _WORDS), lambda w: ~w.rlike(r"^\d+$"))
    return F.try_element_at(parts, F.lit(-1))


def author_similarity(expected: Column, authors: Column) -> Column:
    """Share of the found authors whose family name stands in the expected ones."""
    families = F.filter(F.transform(authors, family_name), lambda f: F.length(f) > 1)
    folded = F.struct(fold(F.coalesce(expected, F.lit(""))).alias("text"), families.alias("families"))
    counts = bind(folded, lambda p: F.struct(F.size(F.filter(p["families"], lambda f: p["text"].contains(f))).alias("hits"), F.size(p["families"]).alias("all")))
    others = expected.rlike(r"(?i)et\s+al|and\s+others")

    def score(n):
        return F.when(n["all"] == 0, F.lit(0).cast("long")).when(others & (n["hits"] > 0), F.lit(100).cast("long")).otherwise(rounded(n["hits"] / n["all"] * 100))

    none = (F.coalesce(expected, F.lit("")) == "") | (F.coalesce(F.size(authors), F.lit(0)) <= 0)
    return F.when(none, F.lit(100).cast("long")).otherwise(bind(counts, score))


def adapter_similarity(a: Column, b: Column) -> Column:
    """Common words over the larger word set; 100 if the cleaned strings are equal."""

    def score(k):
        return bind(F.struct(_tokens(k["x"]).alias("p"), _tokens(k["y"]).alias("q")), lambda t: _shared_words(k["x"] == k["y"], t["p"], t["q"]))

    return bind(F.struct(adapter_key(a).alias("x"), adapter_key(b).alias("y")), score)


def _shared_words(equal: Column, p: Column, q: Column) -> Column:
    most = F.greatest(F.size(p), F.size(q))
    return F.when(equal, F.lit(100).cast("long")).when(most > 0, rounded(F.size(F.array_intersect(p, q)) / most * 100)).otherwise(F.lit(0).cast("long"))


def free_text_similarity(query: Column, title: Column) -> Column:
    """A found title against the free text that should hold it."""
    return bind(F.struct(fold(query).alias("q"), fold(title).alias("t")), lambda p: _free_text(p["q"], p["t"], _better(p["q"], p["t"], query, title)))


def _free_text(q: Column, t: Column, better: Column) -> Column:
    long = lambda c: F.filter(F.split(c, _WORDS), lambda w: F.length(w) >= 3)

    def share(words, text):
        return bind(words, lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: text.contains(w))) / F.size(ws)).otherwise(0.0))

    words = F.struct(share(long(t), q).alias("forward"), share(long(q), t).alias("reverse"))
    enough = lambda s: (s["forward"] >= 0.8) & (s["reverse"] >= 0.4)
    by_words = bind(words, lambda s: F.when(enough(s), rounded(85 + s["forward"] * 15)).otherwise(better))
    return F.when(q.contains(t) | t.contains(q), F.lit(100).cast("long")).otherwise(by_words)


def windowed_similarity(reference: Column, title: Column) -> Column:
    """1 if the title stands in the reference, else the share of its longer words that do."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0)))

    def score(p):
        r, t = p["r"], p["t"]
        shared = bind(words(t), lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_intersect(w, words(r))) / F.size(w)))
        return F.when((r == "") | (F.length(t) < 5), 0.0).when(r.contains(t), 1.0).otherwise(shared)

    return bind(F.struct(F.lower(F.coalesce(reference, F.lit(""))).alias("r"), trim(F.lower(F.coalesce(title, F.lit("")))).alias("t")), score)


@F.pandas_udf(DoubleType())
def sequence_ratio(a, b):
    """Matching-blocks ratio of the lower-cased strings; no built-in computes it."""
    import difflib

    import pandas as pd

    pairs = zip(a.fillna("").str.lower(), b.fillna("").str.lower(), strict=True)
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs], dtype="float64")


def paper_title_score(reference: Column, found: Column) -> Column:
    """Published rule: the larger of edit similarity and token containment, 0 to 1."""
    r, f = fold(reference), fold(found)
    words = lambda c: F.array_distinct(F.filter(F.split(c, _WORDS), lambda w: F.length(w) >= 3))
    longest = F.greatest(F.length(r), F.length(f))
    edit = F.when(longest > 0, 1 - F.levenshtein(r, f) / longest).otherwise(0.0)
    held = F.when(F.size(words(f)) > 0, F.size(F.array_intersect(words(r), words(f))) / F.size(words(f))).otherwise(0.0)
    return F.greatest(edit, held)


def paper_author_score(reference: Column, found: Column) -> Column:
    """Published rule: share of the catalog's surnames (arrays) that the reference has."""
    return F.when(F.size(found) == 0, 1.0).when(F.size(reference) == 0, 0.0).otherwise(F.size(F.array_intersect(F.array_distinct(reference), found)) / F.size(F.array_distinct(found)))


def paper_year_match(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1
