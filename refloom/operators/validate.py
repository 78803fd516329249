"""Field checks of a best candidate: authors, journal, year, penalties, rejection.

Rows have title, authors, journal, year (expected; null where not given), raw,
and found_* columns (title, families, givens, year, years, venue, publisher,
retracted).  Issues are appended in the order of the checks.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.extract import is_preprint, parsed_int
from refloom.functions.similarity import free_text_similarity, similarity
from refloom.functions.text import bind, decode_latex, filled, first_letter, fold, journal_key, rounded, trim, without_metadata

#: Capitalised words of references that are no names.
NOT_NAMES = [
    "vol", "issue", "doi", "http", "https", "org", "com", "www", "pages", "page", "chapter", "edition", "eds", "editor", "editors", "proceedings",
    "conference", "symposium", "workshop", "series", "isbn", "issn", "abstract", "available", "accessed", "online", "retrieved", "publishing",
    "publisher", "publishers", "press", "books", "springer", "elsevier", "wiley", "routledge", "mcgraw", "pearson", "academic", "lexington", "edward",
    "elgar", "sage", "informa", "palgrave", "macmillan", "kluwer", "emerald", "ieee", "acm", "taylor", "francis", "dekker", "plenum", "pergamon",
    "addison", "cambridge", "oxford", "harvard", "princeton", "stanford", "chicago", "columbia", "yale", "university", "institute", "school",
    "dordrecht", "netherlands", "london", "york", "berlin", "heidelberg", "translated", "revised", "reprint", "forthcoming", "review", "journal",
    "annals", "bulletin", "quarterly", "international", "national", "american", "european", "british", "from", "with", "than", "into", "upon",
    "about", "between", "through", "toward", "towards", "across", "beyond",
]

#: Fixed value: the least title score that is accepted.
LEAST_TITLE = 70
REJECTED = "Result rejected — too many mismatches (likely wrong paper found)"


def _long(value) -> Column:
    return F.lit(value).cast("long")


def found_families(families: Column) -> Column:
    return F.filter(F.transform(families, fold), lambda f: F.length(f) > 1)


def first_letters(givens: Column) -> Column:
    """The first letters of the given names that are not blank."""
    return F.transform(F.filter(givens, lambda g: F.length(trim(g)) > 0), first_letter)


def _given(name: Column, letters: Column) -> Column:
    """A given name begins as ``name`` does."""
    return bind(F.when(F.size(letters) != 0, first_letter(name)).otherwise(""), lambda a: F.exists(letters, lambda g: (a != "") & (g == a)))


def extra_authors(authors: Column, families: Column, givens: Column) -> Column:
    """Expected names that match no found family or given name."""
    listed = F.filter(F.transform(F.split(decode_latex(authors), r"(?i)[,&]|\sand\s"), trim), lambda a: F.length(a) > 1)
    known = F.struct(found_families(families).alias("families"), first_letters(givens).alias("letters"))

    def fake(a, p):
        family = bind(fold(a), lambda n: F.exists(p["families"], lambda r: r.contains(n) | n.contains(r)))
        other = bind(F.lower(a), lambda low: low.contains("et al") | low.contains("others") | low.contains("al."))
        return ~family & ~_given(a, p["letters"]) & ~other

    return bind(known, lambda p: F.filter(listed, lambda a: fake(a, p)))


def _held(text: Column, families: Column) -> Column:
    """Struct (hits, all): the found families that stand in a folded text, and all of them."""
    both = F.struct(text.alias("text"), found_families(families).alias("families"))
    return bind(both, lambda p: F.struct(F.size(F.filter(p["families"], lambda f: p["text"].contains(f))).alias("hits"), F.size(p["families"]).alias("all")))


def batch_author_score(authors: Column, families: Column) -> Column:
    others = authors.rlike(r"(?i)\bet\s+al\.?|and\s+others\b")

    def score(n):
        return F.when(n["hits"] > 0, F.when(others, _long(100)).otherwise(F.least(_long(100), rounded(n["hits"] / n["all"] * 100)))).otherwise(similarity(authors, F.array_join(families, ", ")))

    return bind(_held(fold(authors), families), score)


def batch_journal_score(journal: Column, venue: Column, title_score: Column) -> Column:
    """Struct (score, issue); no expected journal is 100."""
    venue = F.coalesce(venue, F.lit(""))
    score = bind(F.struct(journal_key(journal).alias("j"), venue.alias("v")), lambda p: bind(F.struct(similarity(p["j"], p["v"]).alias("s"), fold(p["j"]).alias("a"), fold(p["v"]).alias("b")), _lifted))
    return bind(score, lambda s: _journal_result(journal, venue, s, title_score))


def _lifted(p: Column) -> Column:
    """The similarity of two venues; 95 at least if one holds the other."""
    return F.when((p["s"] < 90) & (p["a"].contains(p["b"]) | p["b"].contains(p["a"])), _long(95)).otherwise(p["s"])


def _journal_result(journal: Column, venue: Column, score: Column, title_score: Column) -> Column:
    version = (score < 50) & (is_preprint(journal) != is_preprint(venue)) & (title_score > 70)
    note = F.concat(F.lit('Version difference: "'), journal, F.lit('" vs "'), venue, F.lit('" (preprint/published)'))
    given = filled(journal).isNotNull()
    return F.struct(F.when(~given, _long(100)).when(version, _long(70)).otherwise(score).alias("score"), F.when(given & version, note).alias("issue"))


def batch_year_score(year: Column, found: Column, all_years: Column, journal: Column, venue: Column, title_score: Column) -> Column:
    """Struct (score, issue); a missing year on either side is 100."""
    gap = F.abs(parsed_int(year) - parsed_int(found))
    near = gap <= 2
    preprint = is_preprint(journal) | is_preprint(venue)
    both = filled(year).isNotNull() & filled(found).isNotNull()
    exact = (year == found) | F.coalesce(F.array_contains(all_years, year), F.lit(False))
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    cases = [
        (near & preprint, 85, text("Year differs by ", gap.cast("string"), " year(s): expected ", year, ", found ", found, " (likely preprint/published version)")),
        (near & (title_score > 80), 85, text("Note: expected ", year, ", CrossRef shows ", found, " (likely online-first vs print date)")),
        ((gap == 1) & (title_score > 70), 75, text("Year differs by 1: expected ", year, ", found ", found, " (possible version difference)")),
    ]
    score, issue = F.when(~both | exact, _long(100)), F.when(~both | exact, F.lit(None).cast("string"))
    for when, points, note in cases:
        score, issue = score.when(when, _long(points)), issue.when(when, note)
    return F.struct(score.otherwise(_long(0)).alias("score"), issue.otherwise(text("Year Mismatch: expected ", year, ", found ", found)).alias("issue"))


def check_batch(rows: DataFrame) -> DataFrame:
    """Structured check: adds the four scores, confidence, accepted and issues."""
    c = F.col
    rows = rows.withColumn("title_score", similarity(c("title"), c("found_title")))
    has_authors = filled(c("authors")).isNotNull()
    rows = rows.withColumn("_extra", F.when(has_authors, extra_authors(c("authors"), c("found_families"), c("found_givens"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("author_score", F.when(has_authors, batch_author_score(c("authors"), c("found_families")) - 20 * F.size("_extra")).otherwise(_long(100)))
    rows = rows.withColumn("_j", batch_journal_score(c("journal"), c("found_venue"), c("title_score"))).withColumn("journal_score", c("_j.score"))
    rows = rows.withColumn("_y", batch_year_score(c("year"), c("found_year"), c("found_years"), c("journal"), c("found_venue"), c("title_score"))).withColumn("year_score", c("_y.score"))
    low_authors = has_authors & (c("author_score") < 50)
    has_journal = filled(c("journal")).isNotNull()
    quoted = lambda head: F.concat(F.lit(head + ': "'), c("journal"), F.lit('" vs "'), F.coalesce(c("found_venue"), F.lit("")), F.lit('"'))
    penalty = F.when(low_authors, 20).otherwise(0) + F.when(has_journal & (c("journal_score") < 40), 20).when(has_journal & (c("journal_score") < 70), 10).otherwise(0)
    issues = F.array_compact(
        F.array(
            F.when(F.size("_extra") > 0, F.concat(F.lit("Extra/Fake Authors detected: "), F.array_join("_extra", ", "))),
            c("_j.issue"),
            c("_y.issue"),
            F.when(low_authors, "Authors mismatch"),
            F.when(has_journal & (c("journal_score") < 40), quoted("Journal mismatch")).when(has_journal & (c("journal_score") < 70), quoted("Journal differs")),
        )
    )
    overall = (c("title_score") + c("author_score") + c("journal_score") + c("year_score")) / 4
    rows = rows.withColumn("confidence", F.least(F.lit(100.0), F.greatest(F.lit(0.0), overall - penalty))).withColumn("issues", issues)
    return decide(rows).drop("_extra", "_j", "_y")


def fake_authors(text: Column, rows: dict[str, Column]) -> Column:
    """Capitalised words of free text that nothing found explains."""
    names = {c: F.coalesce(fold(rows[c]), F.lit("")) for c in ("title", "venue", "publisher")}
    known = F.struct(found_families(rows["families"]).alias("families"), first_letters(rows["givens"]).alias("letters"), *[x.alias(c) for c, x in names.items()])

    def fake(t, n, p):
        family = F.exists(p["families"], lambda r: r.contains(n) | n.contains(r))
        told = functools.reduce(lambda a, b: a | b, [(p[c] != "") & p[c].contains(n) for c in names]) | F.coalesce(rows["year"].contains(t), F.lit(False))
        return (F.length(n) >= 4) & ~n.isin(NOT_NAMES) & ~told & ~family & ~_given(t, p["letters"])

    capital = F.filter(F.split(without_metadata(text), r"[\s,.:;()]+"), lambda t: t.rlike("^[A-Z]"))
    return F.array_distinct(bind(known, lambda p: F.filter(capital, lambda t: bind(fold(t), lambda n: fake(t, n, p)))))


def check_quick(rows: DataFrame) -> DataFrame:
    """Free-text check of ``raw``: adds scores, confidence, accepted and issues."""
    c = F.col
    # columns that several expressions read: each is computed once
    rows = rows.withColumn("_text", fold(c("raw"))).withColumn("_score", free_text_similarity(c("raw"), c("found_title")))
    rows = rows.withColumn("title_score", F.when((c("_score") < 95) & c("_text").contains(fold(c("found_title"))), _long(95)).otherwise(c("_score")))
    rows = rows.withColumn("_held", bind(_held(c("_text"), c("found_families")), lambda n: F.array(n["hits"], n["all"])))
    hits, all_, others = F.get("_held", F.lit(0)), F.get("_held", F.lit(1)), c("raw").rlike(r"(?i)\bet\s+al\.?")
    author = F.when(hits == all_, _long(100)).when(hits > 0, F.when(others, _long(100)).otherwise(rounded(hits / all_ * 100))).otherwise(_long(0))
    none = (hits == 0) & (all_ > 0) & (c("title_score") > 80)
    found = {"families": c("found_families"), "givens": c("found_givens"), "title": c("found_title"), "venue": c("found_venue"), "publisher": c("found_publisher"), "year": c("found_year")}
    rows = rows.withColumn("_fake", fake_authors(c("raw"), found))
    few = F.size("_fake").between(1, 5)
    rows = rows.withColumn("author_score", author - F.when(few, 10 * F.size("_fake")).otherwise(0))
    venue_words = F.filter(F.split(fold(c("found_venue")), r"\s+"), lambda w: F.length(w) >= 4)
    has_venue = F.length(F.coalesce(c("found_venue"), F.lit(""))) > 3
    rows = rows.withColumn("_told", F.exists(venue_words, lambda w: c("_text").contains(w)))
    held = c("_told")
    rows = rows.withColumn("journal_score", F.when(~has_venue, _long(50)).when(held, _long(100)).when(is_preprint(c("found_venue")), _long(60)).otherwise(_long(0)))
    venue_note = F.when(has_venue & ~held & (c("title_score") > 70), F.when(is_preprint(c("found_venue")), F.concat(F.lit('Note: CrossRef returned preprint venue "'), c("found_venue"), F.lit('"'))).otherwise(F.concat(F.lit('Journal Mismatch: actual is "'), c("found_venue"), F.lit('"'))))
    asked = F.regexp_extract_all(c("raw"), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    first = F.get(asked, 0)
    gap = F.abs(parsed_int(first) - parsed_int(c("found_year")))
    wrong = (F.length("found_year") == 4) & (F.size(asked) > 0) & ~F.array_contains(asked, c("found_year")) & ~F.coalesce(F.arrays_overlap(asked, c("found_years")), F.lit(False))
    say = lambda head, tail="": F.concat(F.lit(head), first, F.lit(tail))
    year_note = F.when(
        wrong,
        F.when((gap <= 2) & is_preprint(c("found_venue")), F.concat(say("Note: year ", " vs "), c("found_year"), F.lit(" (preprint/published version difference)")))
        .when((gap <= 2) & (c("title_score") > 80), F.concat(say("Note: year ", " vs "), c("found_year"), F.lit(" (likely online-first vs print date)")))
        .when((gap == 1) & (c("title_score") > 70), F.concat(say("Year differs by 1: you wrote ", ", actual is "), c("found_year"), F.lit(" (possible version difference)")))
        .otherwise(F.concat(say("Year Mismatch: you wrote ", ", actual is "), c("found_year"))),
    )
    issues = F.array_compact(
        F.array(
            F.when(none, "Author Mismatch: none of the real authors found"),
            F.when(few, F.concat(F.lit("Possible Extra/Fake Authors: "), F.array_join("_fake", ", "))),
            F.when(others, "Note: You used 'et al.', please verify if your citation style allows it"),
            venue_note,
            year_note,
        )
    )
    overall = F.when(c("title_score") > 80, F.when(c("author_score") >= 90, c("title_score").cast("double")).otherwise(c("title_score") - (100 - c("author_score")) * 0.5)).otherwise((c("title_score") + c("author_score")) / 2)
    overall = F.greatest(F.lit(0.0), overall - F.when((c("journal_score") == 0) & (c("title_score") > 60), 15).otherwise(0))
    rows = rows.withColumn("year_score", F.lit(None).cast("long")).withColumn("confidence", F.least(F.lit(100.0), overall)).withColumn("issues", issues)
    return decide(rows).drop("_fake", "_text", "_score", "_held", "_told")


def decide(rows: DataFrame) -> DataFrame:
    """Title gate, lift of definite matches, rejection, and the retraction note."""
    c = F.col
    sure = (c("title_score") > 85) & (c("author_score") > 80)
    lifted = F.when(sure & (c("confidence") <= 80), F.greatest(F.lit(65.0), c("confidence"))).otherwise(c("confidence"))
    gate = c("title_score") < LEAST_TITLE
    rejected = ~sure & ((lifted < 40) | (F.size("issues") >= 3))
    retracted = bind(fold(c("found_title")), lambda t: t.contains("retract") | t.contains("withdraw")) | F.coalesce(c("found_retracted"), F.lit(False))
    note = F.when(retracted, F.array(F.lit("🚨 WARNING: This article has been RETRACTED or WITHDRAWN."))).otherwise(F.array().cast("array<string>"))
    return (
        rows.withColumn("_conf", lifted)
        .withColumn("accepted", ~gate & ~rejected)
        .withColumn("retracted", c("accepted") & retracted)
        .withColumn("issues", F.when(gate, F.array().cast("array<string>")).when(rejected, F.array(F.lit(REJECTED))).otherwise(F.concat("issues", note)))
        .withColumn("confidence", F.when(c("accepted"), c("_conf")).otherwise(0.0))
        .drop("_conf")
    )


def future_year_issue(year: Column, as_of_year: int) -> Column:
    """Issue for a year after next year; the clock is a parameter."""
    return F.when(parsed_int(year) > as_of_year + 1, F.concat(F.lit("⚠️ Year "), year, F.lit(" is in the future — verify this is correct")))
