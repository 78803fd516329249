"""Titles within a few edits of each other, found without comparing all of them.

A title that is at most e edits from another holds one of any e + 1 pieces of it
unchanged, and not far from its place.  Each catalog title is cut into e + 1 pieces;
each asked title gives its substrings at the places where such a piece can stand, for
every length within e of its own.  Both meet in an equi-join on length, piece and
characters, and the edit distance, cut off at e, decides.  Titles need no word in
common, so this finds what retrieval by words cannot.

Equal folded titles are compared once.  Titles of at most e characters have empty
pieces and meet all of like length; there are few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import fold


def _cut(length: Column, piece: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a piece of a title of ``length``; the last ones are longer by one."""
    short = F.floor(length / (edits + 1)).cast("int")
    longer = length % (edits + 1)
    return piece * short + F.greatest(F.lit(0), piece - (edits + 1 - longer)), short + (piece >= edits + 1 - longer).cast("int")


def pieces(titles: DataFrame, edits: int) -> DataFrame:
    """(t, size, piece, part): the e + 1 pieces of each title t."""
    rows = titles.select("t", F.length("t").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("piece"))
    start, length = _cut(F.col("size"), F.col("piece"), edits)
    return rows.select("t", "size", "piece", F.substring("t", start + 1, length).alias("part"))


def probes(titles: DataFrame, edits: int) -> DataFrame:
    """(t, size, piece, part): the substrings of t that can be a piece of a title of ``size`` within reach.

    Piece i has at most i edits before it and at most e - i after it, or another piece
    stands unchanged as well.
    """
    own = F.length("t")
    rows = titles.select("t", F.explode(F.sequence(F.greatest(own - edits, F.lit(0)), own + edits)).alias("size"))
    rows = rows.select("t", "size", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("piece"))
    start, length = _cut(F.col("size"), F.col("piece"), edits)
    shift = own - F.col("size")
    low = F.greatest(F.lit(0), start - F.col("piece"), start + shift - (edits - F.col("piece")))
    high = F.least(own - length, start + F.col("piece"), start + shift + (edits - F.col("piece")))
    rows = rows.select("t", "size", "piece", low.alias("low"), high.alias("high"), length.alias("length")).filter("low <= high")
    rows = rows.select("t", "size", "piece", "length", F.explode(F.sequence("low", "high")).alias("at"))
    return rows.select("t", "size", "piece", F.substring("t", F.col("at") + 1, F.col("length")).alias("part")).distinct()


def near_titles(asked: DataFrame, catalog: DataFrame, edits: int = 3, *, asked_id: str = "ref_id", catalog_id: str = "rec_id", title_col: str = "title") -> DataFrame:
    """(asked_id, catalog_id, distance) of all pairs whose folded titles are at most ``edits`` apart; empty titles take no part."""
    folded = lambda df, i: df.select(F.col(i), fold(F.col(title_col)).alias("t")).filter("t <> ''")
    left, right = folded(asked, asked_id), folded(catalog, catalog_id)
    met = probes(left.select("t").distinct(), edits).withColumnRenamed("t", "x").join(pieces(right.select("t").distinct(), edits).withColumnRenamed("t", "y"), ["size", "piece", "part"])
    far = F.levenshtein("x", "y", edits)
    near = met.select("x", "y").distinct().withColumn("distance", far.cast("long")).filter("distance >= 0")
    named = near.join(left.withColumnRenamed("t", "x"), "x").join(right.withColumnRenamed("t", "y"), "y")
    return named.select(asked_id, catalog_id, "distance")
