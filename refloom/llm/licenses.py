"""License scans: exact set-similarity join of text blocks with license templates.

A block is a window of a text with as many words as the template has; line breaks do
not matter, and words further apart than that do not add up.  A template fits a block if
at least ``threshold`` of the template's distinct words are in it.  The join is exact and
uses three filters: the template's words are ordered by how many texts of the corpus
hold them, rarest first, and a fitting text must hold one of the first ``size - need +
1`` of them (prefix filter); it must have at least ``need`` words of the template
(length filter); and the words of the template from its first match on must still
suffice (positional filter).  What is left is verified window by window.

Defined cases: null is an empty text; texts of any length are scanned whole; repeated
documents each get a row, equal texts the same labels; templates that fit alike all
count; empty tables give an empty result; a template without words fits nothing;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.durable import durable
from refloom.llm.text import plain_words

#: The phrases whose places are counted, with their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Short public notices by label; any table of (label, text) can replace them.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under the Creative Commons Attribution-ShareAlike License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]

#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Templates are kept by people; beyond this many the index is joined by shuffle.
BROADCAST_TEMPLATES = 20_000
#: Sets of at most so many template words travel with the tasks.
SET_WORDS = 50_000


def content_key(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("content")


def _small_set(words: DataFrame) -> list[str] | None:
    """The words, if they are few enough to travel with the tasks."""
    found = [r[0] for r in words.limit(SET_WORDS + 1).collect()]
    return found if len(found) <= SET_WORDS else None


def _prefixes(docs: DataFrame, templates: DataFrame, threshold: float, text_col: str, hint) -> tuple[DataFrame, list[str] | None, list[str] | None]:
    """The templates by their prefix words; all their words and the prefix words, where few."""
    words = plain_words(F.col("text"))
    sets = (
        templates.select("label", F.array_sort(F.array_distinct(words)).alias("set"), F.size(words).alias("span"))
        .filter(F.size("set") > 0)
        .groupBy("label", "set")
        .agg(F.max("span").alias("span"))
        .withColumn("template", F.xxhash64("label", "set"))
    )
    vocabulary = sets.select(F.explode("set").alias("word")).distinct()
    known = _small_set(vocabulary)
    held = plain_words(F.col(text_col))
    if known is not None:
        held = F.filter(held, lambda w: w.isin(known))
    frequency = docs.select(F.explode(F.array_distinct(held)).alias("word")).join(hint(vocabulary), "word", "left_semi").groupBy("word").count()
    need = F.ceil(F.size("set") * F.lit(float(threshold)) - F.lit(1e-9)).cast("int")
    ordered = (
        sets.select("template", "label", "span", F.size("set").alias("n"), need.alias("need"), F.explode("set").alias("word"))
        .join(frequency, "word", "left")
        .groupBy("template", "label", "span", "n", "need")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("f"), F.col("word").alias("w")))).alias("o"))
        .select("template", "label", "span", "n", "need", F.transform("o", lambda x: x["w"]).alias("ordered"))
    )
    prefix = F.posexplode(F.slice("ordered", F.lit(1), F.col("n") - F.col("need") + 1)).alias("at", "word")
    index = durable(ordered.select("template", "label", "span", "n", "need", "ordered", prefix), "prefixes")
    return index, known, _small_set(index.select("word").distinct())


def fitting_windows(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, *, text_col: str = "text", small: bool = True, prefixes=None) -> DataFrame:
    """Every (content, template, label, containment) of the best window of a text, at or above the threshold.

    The filters choose the texts, each taken as one set; a best window starts at a word
    of the template.
    """
    hint = F.broadcast if small else (lambda df: df)
    index, known, rare = prefixes or _prefixes(docs, templates, threshold, text_col, hint)
    held = F.transform(plain_words(F.col(text_col)), lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    if known is not None:
        held = F.filter(held, lambda x: x["w"].isin(known))
    texts = docs.select(content_key(text_col), held.alias("held"))
    texts = texts.withColumn("words", F.array_distinct("held.w"))
    first = F.col("words") if rare is None else F.filter("words", lambda w: w.isin(rare))
    candidates = (
        texts.select("content", "held", "words", F.explode(first).alias("word"))
        .join(hint(index.withColumnRenamed("at", "nth")), "word")
        .filter(F.size("words") >= F.col("need"))
        .filter(F.col("n") - F.col("nth") >= F.col("need"))
        .filter(~F.arrays_overlap(F.slice("ordered", F.lit(1), F.col("nth")), "words"))  # its first match only
        .filter(F.size(F.array_intersect("ordered", "words")) >= F.col("need"))
        .withColumn("own", F.filter("held", lambda x: F.array_contains("ordered", x["w"])))
    )
    within = lambda x, j: F.filter(F.slice("own", j + 1, F.col("span")), lambda y: y["at"] < x["at"] + F.col("span"))
    overlap = F.array_max(F.transform("own", lambda x, j: F.size(F.array_distinct(F.transform(within(x, j), lambda y: y["w"])))))
    return candidates.withColumn("overlap", overlap).filter("overlap >= need").select("content", "template", "label", (F.col("overlap") / F.col("n")).alias("containment"))


def _places(words: str) -> Column:
    """Array of (at, label) for every place of a phrase in the word array."""
    found = F.array().cast("array<struct<at:bigint,label:string>>")
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        fits = lambda i: F.forall(F.array(*[F.get(words, i + k) == p for k, p in enumerate(parts)]), lambda x: x)  # noqa: B023, E731
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), fits)
        here = F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))  # noqa: B023
        possible = F.forall(F.array(*[F.array_contains(words, p) for p in parts]), lambda x: x) & (F.size(words) >= len(parts))
        found = F.concat(found, F.when(possible, here).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")))
    return found


def scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, places of phrases, labels of both kinds, score.

    score is the largest containment found, 1 where a phrase stands, else 0.
    """
    if templates is None:
        templates = docs.sparkSession.createDataFrame(TEMPLATES, "label string, text string")
    small = templates.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES
    prefixes = _prefixes(docs, templates, threshold, text_col, F.broadcast if small else (lambda df: df))
    fits = fitting_windows(docs, templates, threshold, text_col=text_col, small=small, prefixes=prefixes)
    fits = fits.groupBy("content").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col), content_key(text_col), plain_words(F.col(text_col)).alias("w"))
    rows = rows.select(id_col, "content", F.size("w").cast("long").alias("n_words"), F.when(F.array_contains("w", "license"), _places("w")).alias("places"))
    joined = rows.join(fits, "content", "left").withColumn("places", F.coalesce("places", F.array().cast("array<struct<at:bigint,label:string>>")))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    return joined.select(
        id_col,
        "n_words",
        "places",
        base.alias("base_labels"),
        F.array_sort(F.array_union(base, F.coalesce("found", none))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
